"""Matching products of two markets: exact signatures, fuzzy names, same-brand specifications, and their cascade."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prices
from ..sources.shared import few, staged
from . import name_index
from .name_index import NameBits  # noqa: F401
from .ranks import beside

ACCEPT, HIGH, SPECS_ABOVE = 70, 85, 70
#: Names on one side of a block of comparisons.
BLOCK_NAMES = 1024


def sorted_tokens(name):
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


def exact_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, score 100) by signature; the right row of least order."""
    known = "signature <> '' and signature <> 'unknown'"
    first = right.where(known).groupBy("signature").agg(F.min("right_id").alias("right_id"))
    return left.where(known).join(first, "signature").select("left_id", "right_id", F.lit(100).alias("score"))


def fuzzy_matches(left: DataFrame, right: DataFrame, accept: int = ACCEPT) -> DataFrame:
    """(left_id, right_id, score): the best right row by sorted-token ratio of at least ``accept``; ties to the least right_id.

    Distinct names are compared, not rows, and only those that an exact index cannot rule out: see name_index.
    """
    tokens = lambda df: df.select("*", sorted_tokens(F.col("name")).alias("tokens")).where("tokens <> ''")
    names = tokens(left).select("tokens").distinct()
    others = tokens(right).groupBy("tokens").agg(F.min("right_id").cast("long").alias("right_id"))
    best = name_index.best_names(names, others, accept, BLOCK_NAMES)
    kind = right.schema["right_id"].dataType
    return left.withColumn("tokens", sorted_tokens(F.col("name"))).join(best.withColumn("right_id", F.col("right_id").cast(kind)), "tokens").select("left_id", "right_id", "score")


def spec_similarity(a, b):
    """Equal values over common keys, 0 to 100; lower-cased; 0 without common keys."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = F.filter(common, lambda k: F.lower(F.element_at(a, k)) == F.lower(F.element_at(b, k)))
    return F.when(F.size(common) > 0, F.size(same) / F.size(common) * 100).otherwise(F.lit(0.0))


#: Sides of one list of equal values that one chunk holds, and pairs of chunks that a task takes in one go.
LIST_ROWS, LISTS_A_GROUP = 2048, 64


def _spec_classes(rows: DataFrame, key: str) -> DataFrame:
    """(brand, form, specs, n_specs, key): rows of one brand and equal specifications are one side of a pair, with their least id."""
    own = rows.where("brand <> '' and brand <> 'Unknown'").select("brand", F.map_from_entries(F.array_sort(F.map_entries("specs"))).alias("specs"), key)
    return own.groupBy("brand", F.to_json("specs").alias("form")).agg(F.min(key).alias(key), F.first("specs").alias("specs")).where("form is not null")


def specs_matches(left: DataFrame, right: DataFrame, above: int = SPECS_ABOVE) -> DataFrame:
    """(left_id, right_id, score): the same-brand right row of most similar specifications, over ``above``; ties to the least right_id.

    A score over 0 needs an equal value, so sides meet in lists of (brand, key, value). The score is the number of lists in
    which two sides meet over that of the keys that they share, and a pair is scored in one list only: the first, by
    name, of those that both are in. A list is cut into chunks of bounded size on either side, and each task compares one
    chunk with one other and gives back one row at most for each left side, so neither a hot brand nor a hot value
    gathers anywhere and no pairs are written. Rows without a brand, or with an unknown one, have no partner.
    """
    again = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of its own, for a cogroup
    a, b = again(staged(_spec_classes(left, "left_id"))), again(staged(_spec_classes(right, "right_id")))
    entry = F.explode(F.map_entries("specs")).alias("e")
    listed = lambda df: df.select("*", entry).where("e.value is not null").select("*", F.col("e.key").alias("k"), F.lower("e.value").alias("v")).drop("e")
    keys = ["brand", "k", "v"]
    chunks = lambda df, n: listed(df).groupBy(*keys).agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias(n))
    sizes = staged(chunks(a, "of_a").join(chunks(b, "of_b"), keys))  # lists that both sides have
    own = lambda n: F.pmod(F.xxhash64("form"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    groups = max(1, -(-int(sizes.agg(F.sum(F.col("of_a").cast("long") * F.col("of_b"))).first()[0] or 0) // LISTS_A_GROUP))
    part = F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(groups)).alias("part")
    x = listed(a).join(sizes, keys).withColumn("i", own("of_a")).withColumn("j", each("of_b")).select(part, *keys, "i", "j", "form", F.to_json("specs").alias("text"))
    y = listed(b).join(again(sizes), keys).withColumn("j", own("of_b")).withColumn("i", each("of_a")).select(part, *keys, "i", "j", F.to_json("specs").alias("text"), F.col("right_id").cast("long").alias("right_id"))
    found = x.groupBy("part").cogroup(y.groupBy("part")).applyInArrow(_best_specs(above), "brand string, form string, right_id long, score double")
    best = found.groupBy("brand", "form").agg(F.min(F.struct((-F.col("score")).alias("s"), "right_id")).alias("m"))
    kind = right.schema["right_id"].dataType
    forms = left.withColumn("form", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("specs")))))
    return forms.join(best, ["brand", "form"]).select("left_id", F.col("m.right_id").cast(kind).alias("right_id"), (-F.col("m.s")).alias("score"))


def _codes(sides: list[dict], columns: dict, values: dict) -> np.ndarray:
    """A row of value codes for each side, one column for each key, -1 where it lacks the key and -2 where its value is null."""
    out = np.full((len(sides), len(columns)), -1, np.int64)
    for n, specs in enumerate(sides):
        for k, v in specs.items():
            out[n, columns[k]] = -2 if v is None else values.setdefault(v.lower(), len(values))
    return out


def _best_specs(above: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"brand": [], "form": [], "right_id": [], "score": []}
        lists: dict[tuple, tuple[list, list]] = {}
        right = right.sort_by("right_id")
        for side, table in enumerate((left, right)):
            for n, at in enumerate(zip(*(table.column(c).to_pylist() for c in ("brand", "k", "v", "i", "j")), strict=True)):
                lists.setdefault(at, ([], []))[side].append(n)
        texts, forms, ids = [t.column("text").to_pylist() for t in (left, right)], left.column("form").to_pylist(), right.column("right_id").to_numpy()
        for (brand, name, *_), (mine, theirs) in lists.items():
            if not mine or not theirs:
                continue
            own, others = ([json.loads(texts[side][n]) for n in rows] for side, rows in ((0, mine), (1, theirs)))
            columns = {k: i for i, k in enumerate(sorted({k for specs in (*own, *others) for k in specs}))}
            values: dict[str, int] = {}
            a, b = (_codes(side, columns, values) for side in (own, others))
            before = [i for k, i in columns.items() if k < name]
            for n, row in enumerate(a):
                both = (row != -1) & (b != -1)
                same = both & (row == b) & (row >= 0)
                score = np.where(same[:, before].any(1), 0.0, same.sum(1) / np.maximum(both.sum(1), 1) * 100)  # else met in an earlier list
                best = int(score.argmax())  # the first of equals has the least right_id
                if score[best] > above:
                    for column, value in zip(out.values(), (brand, forms[mine[n]], int(ids[theirs[best]]), float(score[best])), strict=True):
                        column.append(value)
        return pa.table({"brand": pa.array(out["brand"], pa.string()), "form": pa.array(out["form"], pa.string()), "right_id": pa.array(out["right_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


#: What the cascade reads of a row.
_READ = ["signature", "name", "brand", "_form"]


def _with_form(rows: DataFrame) -> DataFrame:
    """Specifications as text: the JSON object that they come from (column ``form``), or one made of the map ``specs``."""
    return rows.withColumn("_form", F.col("form") if "form" in rows.columns else F.to_json(F.array_sort(F.map_entries("specs"))))


def _kinds(rows: DataFrame, key: str) -> DataFrame:
    """One row for each kind of rows that the cascade can't tell apart, with their least id."""
    by = _with_form(rows).groupBy(*_READ)
    if "form" in rows.columns:
        return staged(by.agg(F.min(key).alias(key)).withColumn("specs", F.from_json("_form", "map<string,string>")))
    return staged(by.agg(F.min(key).alias(key), F.first("specs").alias("specs")))


def found_by_kinds(left: DataFrame, right: DataFrame) -> DataFrame:
    """(signature, name, brand, _form, right_id, score, method, confidence): what each kind of left rows finds, if anything.

    Exact, else the better of fuzzy and, where fuzzy is under 85, specifications. Ids are unique on their side. Shops list
    equal products again and again, and of equal right rows only the one of the least id can be found, so kinds of rows go
    through the cascade. Rows have ``specs``, a map, or ``form``, their JSON object, which is read once for each kind.
    """
    kinds = _kinds(left, "left_id")
    best = _best_of_levels(kinds, _kinds(right, "right_id"))
    return few(staged(kinds.drop("specs").join(best, "left_id").drop("left_id")))


def match_cascade(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, score, method, confidence): left rows with what their kinds have found."""
    return beside(_with_form(left).select("left_id", *_READ), found_by_kinds(left, right), _READ).select("left_id", "right_id", "score", "method", "confidence")


def unmatched_left(left: DataFrame, found: DataFrame) -> DataFrame:
    """Left rows whose kinds have found nothing."""
    kinds, rows = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(_READ)]), _with_form(left)
    on = [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(_READ)]
    return rows.join(kinds, on, "left_anti").drop("_form")


def _best_of_levels(left: DataFrame, right: DataFrame) -> DataFrame:
    exact = exact_matches(left, right).withColumn("method", F.lit("exact"))
    rest = left.join(exact.select("left_id"), "left_id", "left_anti")
    fuzzy = staged(fuzzy_matches(rest, right).withColumn("method", F.lit("fuzzy")))
    open_ = rest.join(fuzzy.where(F.col("score") >= HIGH).select("left_id"), "left_id", "left_anti")
    specs = specs_matches(open_, right).withColumn("method", F.lit("specs"))
    both = exact.withColumn("score", F.col("score").cast("double")).unionByName(fuzzy.withColumn("score", F.col("score").cast("double"))).unionByName(specs)
    order = Window.partitionBy("left_id").orderBy(F.col("score").desc(), "method", "right_id")
    best = both.where(F.col("score") >= ACCEPT).withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")
    return best.withColumn("confidence", confidence(F.col("score")))


def confidence(score):
    return F.when(score >= HIGH, "high").when(score >= ACCEPT, "medium").otherwise("low")


def unmatched(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Rows without a match, by their ids."""
    return rows.join(matches.select(key).distinct(), key, "left_anti")


#: Names of the cascade's levels in reports.
METHODS = {"exact": "exact_signature", "fuzzy": "fuzzy_string", "specs": "specs_based"}


def price_differences(found: DataFrame, left: DataFrame, right: DataFrame, also: Sequence[str] = (), sides: Sequence[str] = ()) -> DataFrame:
    """One row for each match: both prices, the left one in euros too, how they differ, confidence and match_method.

    found is found_by_kinds's; left and right have what it read and price_value, of the left in dinars and of the right in
    euros. Kinds are joined with the right rows that they have found, and left rows with their kinds. ``also`` names columns
    of the left that go along, ``sides`` those of both, as tn_ and fr_.
    """
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("price_value", *sides)]
    kinds = few(staged(right.select("right_id", *side("fr")).join(found, "right_id")))
    rows = beside(_with_form(left).select(*_READ, *also, *side("tn")), kinds, _READ)
    rows = rows.withColumn("eur", F.col("tn_price_value") * prices.rate(F.lit("TND"), "EUR"))
    method = F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.col("method"))
    compared = prices.comparison(F.col("eur"), F.col("fr_price_value"))
    told = ["eur", "score", "confidence", *[f"{p}_{c}" for p in ("tn", "fr") for c in ("price_value", *sides)], *also]
    return rows.select(*told, *[c.alias(k) for k, c in compared.items()], method.alias("match_method"))


def compare_prices(found: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The price comparison of matched products: one flat row for each match, with both prices in euros.

    found, left and right are as price_differences has them, with product_id, product_name, source and product_url.
    """
    rows = price_differences(found, left, right, sides=["product_id", "product_name", "source", "product_url"])
    return rows.select(
        F.concat(F.lit("match_"), "tn_product_id", F.lit("_"), "fr_product_id").alias("match_id"),
        "tn_product_id",
        "tn_product_name",
        F.col("tn_price_value").alias("tn_price_tnd"),
        F.round("eur", 2).alias("tn_price_eur"),
        "tn_source",
        F.col("tn_product_url").alias("tn_url"),
        "fr_product_id",
        "fr_product_name",
        F.col("fr_price_value").alias("fr_price_eur"),
        "fr_source",
        F.col("fr_product_url").alias("fr_url"),
        "price_diff_eur",
        "price_diff_pct",
        "cheaper_country",
        "savings_eur",
        F.round(F.abs(F.col("eur") - F.col("fr_price_value")) * prices.rate(F.lit("EUR"), "TND"), 2).alias("savings_tnd"),
        F.round(F.col("score") / 100, 3).alias("match_score"),
        "confidence",
        "match_method",
        prices.rate(F.lit("TND"), "EUR").alias("exchange_rate"),
    )


def match_report(compared: DataFrame, left: DataFrame) -> DataFrame:
    """One row: products, matches, match rate, tiers, mean differences and where it is cheaper."""
    tier = lambda t: F.count_if(F.col("confidence") == t).alias(t)
    one = compared.agg(
        F.count("*").alias("matches"), *map(tier, ("high", "medium", "low")), F.round(F.avg("price_diff_eur"), 2).alias("avg_diff_eur"), F.round(F.avg("price_diff_pct"), 2).alias("avg_diff_pct"),
        F.count_if(F.col("cheaper_country") == "Tunisia").alias("cheaper_in_tn"), F.count_if(F.col("cheaper_country") == "France").alias("cheaper_in_fr"),
    )
    both = left.agg(F.count("*").alias("products")).crossJoin(F.broadcast(one))
    return both.withColumn("match_rate", F.round(F.try_divide(F.col("matches") * 100.0, F.col("products")), 4))
