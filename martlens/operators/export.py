"""Document exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def categories(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(f"cat_{i:06d}", n) for i, n in enumerate(names, 1)], "category_id string, category string")


def with_category_id(products: DataFrame, dim: DataFrame, default: str = "Other") -> DataFrame:
    """category_id by name; unknown and null names get that of ``default``. The dimension is a fixed list."""
    other = dim.where(F.col("category") == default).select(F.col("category_id").alias("_other"))
    return products.join(F.broadcast(dim), "category", "left").crossJoin(F.broadcast(other)).withColumn("category_id", F.coalesce("category_id", "_other")).drop("_other")


def round_robin(reviews: DataFrame, products: DataFrame, review_key: str, product_key: str) -> DataFrame:
    """(review, product): the i-th review goes to product i modulo their number; numbering is by ranges of the keys."""
    from .catalog import with_ids

    number = lambda df, key, name: with_ids(df.select(key), key, name, "%d").withColumn(name, F.col(name).cast("long") - 1)
    r, p = number(reviews, review_key, "i"), number(products, product_key, "j")
    n = F.least(F.lit(products.count()), F.lit(reviews.count()))
    return r.withColumn("j", F.pmod("i", n)).join(p, "j").select(review_key, product_key)


def price_history(products: DataFrame, key: str, price: str, days: Sequence[int] = (30, 21, 14, 7, 0), seed: str = "history", first: int = 50) -> DataFrame:
    """(key, days_ago, price) of the first products, with seeded noise of up to 5 %; a fixed number of rows is the feature."""
    rows = products.orderBy(key).limit(first).select(key, price, F.explode(F.array(*[F.lit(d) for d in days])).alias("days_ago"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("days_ago").cast("string")).cast("binary"))
    noise = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") / 16777215.0 * 0.1 - 0.05
    return rows.select(key, "days_ago", F.round(F.col(price) * (1 + noise), 4).alias("price"))


def latest_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc()))).where("_i = 1").drop("_i")


def parse_specs(text: Column) -> Column:
    """A JSON object of strings as a map; what does not parse is an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def product_documents(products: DataFrame, dim: DataFrame) -> DataFrame:
    """Unified products as documents: category ids instead of names, specifications as a map, everything in stock."""
    rows = with_category_id(products, dim)
    return rows.select(
        F.col("product_id").alias("_id"), F.coalesce("product_name", F.lit("")).alias("name"), F.coalesce("product_name_normalized", F.lit("")).alias("name_normalized"), F.coalesce("brand", F.lit("Unknown")).alias("brand"), "model",
        "category_id", F.col("price_value").alias("price"), F.coalesce("currency", F.lit("TND")).alias("currency"), F.coalesce("country", F.lit("Tunisia")).alias("country"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("product_url", F.lit("")).alias("url"), "image_url", parse_specs(F.col("specifications")).alias("specifications"), F.coalesce("product_signature", F.lit("")).alias("product_signature"), F.lit(True).alias("in_stock"), "scraped_at",
    )


#: What a review document has where its row has nothing.
REVIEW_DEFAULTS = {"text": "", "rating": 5, "author": "Anonymous", "language": "fr", "is_fake": False, "fake_probability": 0.0, "xgboost_score": 0.0, "bert_score": 0.0, "ensemble_score": 0.0, "confidence": "low", "sentiment": "neutral"}


def review_documents(reviews: DataFrame, products: DataFrame, review_key: str, product_key: str) -> DataFrame:
    """Reviews as documents with ids from 0, each with a product by turns; columns that are absent or null get defaults."""
    from .catalog import with_ids

    rows = with_ids(reviews, review_key, "_n", "%d").withColumn("_n", F.col("_n").cast("long") - 1)
    turns = round_robin(reviews, products, review_key, product_key)
    rows = rows.join(turns, review_key)
    value = lambda c, d: F.coalesce(F.col(c).cast({bool: "boolean", int: "int", float: "double", str: "string"}[type(d)]), F.lit(d)) if c in reviews.columns else F.lit(d)
    return rows.select(F.format_string("review_%06d", "_n").alias("_id"), F.col(product_key).alias("product_id"), *[value(c, d).alias(c) for c, d in REVIEW_DEFAULTS.items()])


def collection_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(collection, n) of every collection."""
    counts = [df.agg(F.lit(name).alias("collection"), F.count("*").alias("n")) for name, df in frames.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


#: Sample rows of the collections that no table feeds: (columns, rows).
SAMPLE_COLLECTIONS = {
    "users": ("_id string, email string, role string", [("user_000001", "admin@example.com", "admin"), ("user_000002", "user@example.com", "user")]),
    "user_profiles": ("_id string, user_id string, full_name string, location string, language string, currency_preference string", [("profile_000001", "user_000001", "Admin User", "Tunis", "fr", "TND"), ("profile_000002", "user_000002", "Regular User", "Paris", "fr", "EUR")]),
    "stores": ("_id string, name string, country string, currency string", [("store_000001", "shop_tn", "Tunisia", "TND"), ("store_000002", "listed", "Tunisia", "TND"), ("store_000003", "shop_fr", "France", "EUR")]),
    "search_history": ("_id string, user_id string, query string, results_count int", [("search_000001", "user_000002", "laptop HP", 45), ("search_000002", "user_000002", "gaming monitor", 23)]),
}


def sample_collection(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = SAMPLE_COLLECTIONS[name]
    return spark.createDataFrame(rows, columns)


def store_documents(stores: DataFrame, products: DataFrame) -> DataFrame:
    """Stores (_id, name, country, currency) with their number of products, how many are in stock and the mean price; zeros and
    null where a store has none. ``stores`` is a short list; products have (source, in_stock, price_value)."""
    found = products.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("products"), F.count_if("in_stock").alias("in_stock"), F.round(F.avg("price_value"), 2).alias("mean_price"))
    rows = stores.join(found, "name", "left")
    return rows.select("_id", "name", "country", "currency", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("products", "in_stock")], "mean_price")


def search_documents(searches: DataFrame, products: DataFrame, name: str = "product_name_normalized") -> DataFrame:
    """Searches (_id, user_id, query) with results_count: products whose normalized name holds every word of the query.

    The searches are a stated list that the driver holds, so each product is read once and gives a row only for a search
    that finds it, counted before the shuffle. A search without words finds nothing.
    """
    asked = [(r["_id"], sorted(set((r["query"] or "").lower().split()))) for r in searches.select("_id", "query").collect()]
    listed = F.array(*[F.when(F.lit(True) if not words else ~F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.coalesce(F.col(name), F.lit("")), w)), None).otherwise(F.lit(i)) for i, words in asked])
    hits = products.select(F.explode(F.array_compact(listed)).alias("_id")).groupBy("_id").agg(F.count("*").alias("n"))
    return searches.join(hits, "_id", "left").select("_id", "user_id", "query", F.coalesce("n", F.lit(0)).alias("results_count"))


def object_ids(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, one_based, zero_based): generic ids of six digits in the order of a key."""
    from .catalog import with_ids

    i = with_ids(df.select(key), key, "_i", "%d").withColumn("_i", F.col("_i").cast("long"))
    form = lambda n: F.format_string(f"{prefix}_%06d", n)
    return i.select(key, form(F.col("_i")).alias("one_based"), form(F.col("_i") - 1).alias("zero_based"))
