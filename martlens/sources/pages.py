"""Records from HTML pages and pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prices
from ..functions.text import absolute_url, is_blocked, is_missing_page, product_id_from_url
from .markup import select_items


def page_url(base: Column, page: Column, style: str) -> Column:
    """Addresses of result pages: ``query`` (?page=n or &page=n), ``path`` (/pageN/) or ``id`` (?id=base&p=n)."""
    if style == "path":
        return F.concat(F.rtrim(base, F.lit("/")), F.lit("/page"), page.cast("string"), F.lit("/"))
    if style == "id":
        return F.concat(F.lit("?id="), base, F.lit("&p="), page.cast("string"))
    return F.concat(base, F.when(F.contains(base, F.lit("?")), "&page=").otherwise("?page="), page.cast("string"))


def until_first_empty(pages: DataFrame, key: str, page: str, items: str) -> DataFrame:
    """Pages of a listing before its first one without items."""
    first = F.min(F.when(F.col(items) == 0, F.col(page))).over(Window.partitionBy(key))
    return pages.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, product_id, blocked, title, n_links, n_paragraphs), scripts, styles and comments taken out first."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return pages.select(
        "page_id",
        product_id_from_url(F.col("url")).alias("product_id"),
        F.coalesce(is_blocked(F.col("html")), F.lit(False)).alias("blocked"),
        F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href=")).cast("long").alias("n_links"),
        F.regexp_count(html, F.lit(r"(?i)<p[\s>]")).cast("long").alias("n_paragraphs"),
    )


#: What opens an item on a shop's result pages, in the order in which they are tried.
ITEM_OPENINGS = [r"<article\b", r'<li\b[^>]*class="[^"]*\bproduct-item\b', r'<div\b[^>]*class="[^"]*\bproduct-container\b']


def items(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, i, item): the items of each page, by the first kind of opening that the page has; pages without any have none."""
    padded = F.concat(F.lit(" "), F.col(html))  # so that what comes first is no item
    kinds = [F.slice(F.split(padded, f"(?i)(?={p})"), F.lit(2), F.lit(2**31 - 1)) for p in ITEM_OPENINGS]
    found = F.coalesce(*[F.when(F.size(k) > 0, k) for k in kinds], F.array().cast("array<string>"))
    return pages.select(key, F.posexplode(found).alias("i", "item"))


def _inner(item: Column, name: str) -> Column:
    """The text of the first element with that class; null if there is none or it is empty."""
    found = F.regexp_extract(item, rf'(?is)<[a-z0-9]+\b[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</', 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"<[^>]*>", "")), F.lit(""))


def _attribute(item: Column, tag: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(item, rf'(?is)<{tag}(?=[\s>])[^>]*?\s{name}="([^"]*)"', 1), F.lit(""))


def shop_records(found: DataFrame, base: str, shop: str, millimes: bool = True) -> DataFrame:
    """Items as product records: id, title, price, regular_price, discount_percent, brand, sku, url, image, description,
    in_stock. Items without a title are none."""
    item = F.col("item")
    price = (lambda c: prices.millimes_price(c)) if millimes else (lambda c: prices.scraped_price(c))
    url = F.coalesce(_attribute(item, "a", "href"), F.lit(""))
    rows = found.withColumns(
        {
            "title": F.nullif(F.trim(F.regexp_extract(item, r"(?is)<a\b[^>]*>(.*?)</a>", 1)), F.lit("")),
            "price": price(_inner(item, "final-price")),
            "regular_price": price(_inner(item, "original-price")),
            "brand": _attribute(item, 'img class="brand"', "alt"),
            "sku": _inner(item, "sku"),
            "url": absolute_url(url, base),
            "image": F.coalesce(_attribute(item, 'img class="photo"', "data-src"), _attribute(item, 'img class="photo"', "src")),
            "description": _inner(item, "search-short-description"),
            "in_stock": prices.in_stock(_inner(item, "stock"), shop),
        }
    ).where("title is not null")
    rows = rows.withColumn("discount_percent", F.coalesce(prices.discount_percent(F.col("regular_price"), F.col("price")), F.lit(0.0)))
    return rows.withColumn("id", F.coalesce(_attribute(item, "[a-z]+", "data-product-id"), product_id_from_url(F.col("url")))).drop("item")


#: Where a shop's result pages have an item's fields.
ITEM_SELECTORS = ["article", "li.product-item", "div.product-container"]
FIELD_SELECTORS = {
    "id": "@data-product-id", "title": ".product-item-name a", "url": ".product-item-name a@href", "sku": ".sku", "final_price": ".price-box .final-price", "original_price": ".price-box .original-price",
    "brand": ".brand img@alt", "stock": ".stock", "image": ".product-item-photo img@src", "image_later": ".product-item-photo img@data-src", "description": ".search-short-description",
}


def product_records(pages: DataFrame, key: str, base: str, shop: str, millimes: bool = True, **fields: str) -> DataFrame:
    """Items of result pages as product records, read by selectors: (key, i) and the columns of shop_records.

    ``fields`` replaces selectors of FIELD_SELECTORS for shops that write their pages otherwise. Items without a title are
    none; a url is completed with ``base``, and without an own id an item has that of its url.
    """
    price = prices.millimes_price if millimes else prices.scraped_price
    rows = select_items(pages, key, ITEM_SELECTORS, FIELD_SELECTORS | fields)
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.where(given("title").isNotNull())
    url = absolute_url(F.coalesce("url", F.lit("")), base)
    records = rows.select(
        key, "i", F.coalesce(given("id"), product_id_from_url(url)).alias("id"), given("title").alias("title"), price(given("final_price")).alias("price"), price(given("original_price")).alias("regular_price"),
        given("brand").alias("brand"), given("sku").alias("sku"), url.alias("url"), F.coalesce(given("image_later"), given("image")).alias("image"), given("description").alias("description"), prices.in_stock(given("stock"), shop).alias("in_stock"),
    )
    return records.withColumn("discount_percent", F.coalesce(prices.discount_percent(F.col("regular_price"), F.col("price")), F.lit(0.0)))


def discounts(records: DataFrame) -> DataFrame:
    """One row: items, in and out of stock, how many are discounted and by how much on average."""
    on = F.col("discount_percent") > 0
    return records.agg(F.count("*").alias("items"), F.count_if("in_stock").alias("in_stock"), F.count_if(~F.col("in_stock")).alias("out_of_stock"), F.count_if(on).alias("discounted"), F.round(F.avg(F.when(on, F.col("discount_percent"))), 1).alias("avg_discount"))


def category_urls(asked: DataFrame, categories: DataFrame) -> DataFrame:
    """Asked (key) with the url of each category (key, url), a short list; unknown keys have no row."""
    return asked.join(F.broadcast(categories), "key")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with ``allowed``: the first rule of the host, by ``place``, whose path begins the url's path decides; without
    one it is allowed. rules has (host, place, path, allow)."""
    host, path = F.parse_url("url", F.lit("HOST")), F.coalesce(F.nullif(F.parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    rows = urls.select("url").distinct().withColumns({"host": host, "path": path})
    hit = rows.join(rules.select("host", "place", F.col("path").alias("rule"), "allow"), "host").where(F.startswith("path", "rule") & (F.col("rule") != ""))
    first = hit.groupBy("url").agg(F.min_by("allow", "place").alias("allow"))
    return urls.join(first, "url", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def page_status(pages: DataFrame) -> DataFrame:
    """(page_id, status): blocked, missing or read."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.when(is_blocked(html), "blocked").when(is_missing_page(html), "missing").otherwise("read").alias("status"))
