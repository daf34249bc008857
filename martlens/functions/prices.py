"""Price strings, currency conversion and price comparison, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

_NUMBER = r"^-?[0-9]*\.?[0-9]+$"


def parse_number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def clean_price(text: Column) -> Column:
    """EU or US notation by which of comma and dot comes first; null unless within 0 and a million; two decimals."""
    kept = F.replace(F.regexp_replace(text, r"[^\d.,\s-]", ""), F.lit(" "), F.lit(""))
    comma, dot = F.instr(kept, ","), F.instr(kept, ".")
    eu = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    us = F.replace(kept, F.lit(","), F.lit(""))
    one = F.replace(kept, F.lit(","), F.lit("."))
    value = parse_number(F.when((comma > 0) & (dot > 0), F.when(dot < comma, eu).otherwise(us)).when(comma > 0, one).otherwise(kept))
    return F.when(value.between(0, 1_000_000), F.round(value, 2))


def millimes_price(text: Column, divisor: float = 1000.0) -> Column:
    """``429,000 DT``: commas group thousandths of the unit."""
    return parse_number(F.regexp_replace(text, r"[^\d.]", "")) / divisor


def decimal_comma_price(attribute: Column, text: Column) -> Column:
    """A machine-readable attribute if it parses, else the text with a decimal comma."""
    return F.coalesce(parse_number(attribute), parse_number(F.replace(F.regexp_replace(text, r"[^\d.,]", ""), F.lit(","), F.lit("."))))


def rate(source: Column, target: str) -> Column:
    """The listed rate, else the inverse of the listed opposite, else 1."""
    out = F.lit(1.0)
    for (a, b), r in fixed.RATES.items():
        if a == target and (b, a) not in fixed.RATES:
            out = F.when(source == b, F.lit(1.0 / r)).otherwise(out)
    for (a, b), r in fixed.RATES.items():
        if b == target:
            out = F.when(source == a, F.lit(r)).otherwise(out)
    return out


def discount_percent(regular: Column, price: Column) -> Column:
    return F.when(regular > price, F.round((regular - price) / regular * 100, 2)).otherwise(F.lit(0.0))


def comparison(home_eur: Column, abroad_eur: Column) -> dict[str, Column]:
    diff = home_eur - abroad_eur
    return {
        "price_diff_eur": F.round(diff, 2),
        "price_diff_pct": F.round(F.try_divide(diff, abroad_eur) * 100, 2),
        "cheaper_country": F.when(diff > 0, "France").otherwise("Tunisia"),
        "savings_eur": F.round(F.abs(diff), 2),
    }


def text_price(text: Column) -> Column:
    """clean_price without range and rounding: the first of comma and dot tells the notation."""
    kept = F.replace(F.regexp_replace(text, r"[^\d.,\s-]", ""), F.lit(" "), F.lit(""))
    return parse_number(_decimal(kept, F.instr(kept, ".") < F.instr(kept, ",")))


def scraped_price(text: Column) -> Column:
    """A shop page's price: the last of comma and dot is the decimal mark."""
    kept = F.regexp_replace(text, r"[^\d.,]", "")
    last = lambda mark: F.length(F.substring_index(kept, mark, -1))
    return parse_number(_decimal(kept, last(",") < last(".")))


def _decimal(kept: Column, comma: Column) -> Column:
    """Digits with a decimal point: where both marks are there, ``comma`` says which one is the decimal mark."""
    eu = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    us = F.replace(kept, F.lit(","), F.lit(""))
    has = lambda mark: F.contains(kept, F.lit(mark))
    return F.when(has(",") & has("."), F.when(comma, eu).otherwise(us)).when(has(","), F.replace(kept, F.lit(","), F.lit("."))).otherwise(kept)


def in_stock(remark: Column, shop: str) -> Column:
    """A shop's stock remark: sold out if the home shop says so; available if the shop abroad says so, and where there is
    no remark; at the third shop (``listed``) available only if it says so, in these very words."""
    low = F.lower(remark)
    if shop == "shop_tn":
        return F.coalesce(~low.contains("épuisé"), F.lit(True))
    if shop == "listed":
        return F.coalesce(remark.contains("En stock") | remark.contains("Disponible"), F.lit(False))
    return F.coalesce(low.contains("disponible") | low.contains("en stock"), F.lit(True))


def lookup_rates(amounts: DataFrame, rates: DataFrame, target: str, amount: str = "amount", currency: str = "currency") -> DataFrame:
    """Amounts with ``rate`` and ``converted``: the same currency has 1, then the listed rate, the inverse of the listed
    opposite, and 1. rates (source, target, rate) is a short list."""
    direct = rates.where(F.col("target") == target).select(F.col("source").alias(currency), F.col("rate").alias("_direct"))
    back = rates.where(F.col("source") == target).select(F.col("target").alias(currency), F.col("rate").alias("_back"))
    rows = amounts.join(F.broadcast(direct), currency, "left").join(F.broadcast(back), currency, "left")
    rate = F.when(F.col(currency) == target, F.lit(1.0)).otherwise(F.coalesce("_direct", F.try_divide(F.lit(1.0), F.col("_back")), F.lit(1.0)))
    return rows.withColumn("rate", rate).withColumn("converted", F.col(amount) * F.col("rate")).drop("_direct", "_back")
