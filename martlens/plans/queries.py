"""Registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, prices, text
from ..operators import catalog, export, lifecycle, matching, monitoring, reviews, stats, training
from ..operators.ranks import quantiles, with_quantiles
from ..sources import pages
from ..sources.shared import staged
from ..sources.tables import OFFERS_SQL, REVIEWS_SQL, RUNS_SQL, SCORES_SQL, TITLES_SQL, VERSIONS_SQL, offers, scores, table, titles, versions
from ..sources.tables import reviews as review_rows
from ..sources.tables import runs as run_rows
from ..streaming.events import tumbling
from .registry import ORACLE_SQL, QUERIES, query, quoted

_q = quoted
_TIES = ["product_url", "row_a", "row_b", "row_c", "price_value"]
_LATEST_SQL = f"{OFFERS_SQL}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_url ORDER BY scraped_at DESC, row_a, row_b, row_c, price_value) AS i FROM offers) WHERE i = 1)"
_EUR = "price_value * CASE WHEN currency = 'TND' THEN 0.304 ELSE 1.0 END"


# Listings


@query(f"WITH {OFFERS_SQL} SELECT country, currency, source, count(*) AS n, count(product_url) AS with_url FROM offers GROUP BY ALL")
def offers_union_sources(spark, sf):
    rows = offers(spark, sf)
    sides = [rows.where(F.col("country") == c).select(F.col("product_name").alias(n), F.col("price_value").alias(p), F.col("product_url").alias("url"), F.col("source").alias("shop")) for c, n, p in (("Tunisia", "title", "prix"), ("France", "name", "price"))]
    out = catalog.union_sources([catalog.standardize(sides[0], "a", "Tunisia", "TND"), catalog.standardize(sides[1], "b", "France", "EUR")])
    return out.groupBy("country", "currency", F.col("shop").alias("source")).agg(F.count("*").alias("n"), F.count("product_url").alias("with_url"))


@query(f"WITH {_LATEST_SQL} SELECT product_url, product_name, price_value, scraped_at, row_a, row_b FROM latest")
def offers_dedup_latest(spark, sf):
    return catalog.latest_by_url(offers(spark, sf), _TIES).select("product_url", "product_name", "price_value", "scraped_at", "row_a", "row_b")


@query(f"WITH {OFFERS_SQL} SELECT country, count(*) AS n, round(avg(price_value), 4) AS avg_price FROM offers WHERE trim(product_name) <> '' AND price_value > 0 AND price_value <= 1000000 AND product_url <> '' GROUP BY country")
def offers_validate(spark, sf):
    return catalog.valid(offers(spark, sf)).groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("price_value"), 4).alias("avg_price"))


@query(f"WITH {_LATEST_SQL} SELECT country, count(*) AS n, CAST((SELECT count(*) FROM offers) AS BIGINT) AS loaded, round(count(*) * 100.0 / (SELECT count(*) FROM offers), 4) AS retention_pct FROM latest GROUP BY country")
def retention(spark, sf):
    rows = offers(spark, sf)
    loaded = rows.agg(F.count("*").alias("loaded"))
    kept = catalog.latest_by_url(rows, _TIES).groupBy("country").agg(F.count("*").alias("n"))
    return kept.crossJoin(F.broadcast(loaded)).withColumn("retention_pct", F.round(F.col("n") * 100.0 / F.col("loaded"), 4))


@query("SELECT p_partkey, format('prod_{:05d}', row_number() OVER (ORDER BY p_partkey)) AS product_id FROM part")
def product_ids(spark, sf):
    return catalog.with_ids(table(spark, sf, "part").select("p_partkey"), "p_partkey")


@query("SELECT l_linenumber, count(CASE WHEN l_linenumber > 0 THEN TIMESTAMP '2024-01-01' END) AS n FROM lineitem GROUP BY 1")
def default_scraped_at(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_linenumber", F.lit(None).cast("timestamp").alias("scraped_at"))
    out = catalog.default_scraped_at(rows, "2024-01-01")
    return out.groupBy("l_linenumber").agg(F.count("scraped_at").alias("n"))


@query("SELECT l_linenumber, count(*) AS n, count(CASE WHEN l_orderkey % 3 <> 0 THEN 1 END) AS dated, max(CASE WHEN l_orderkey % 3 <> 0 THEN l_shipdate END) AS latest FROM lineitem GROUP BY 1")
def default_scraped_at_mixed(spark, sf):
    """Some rows have a time, so the others keep none."""
    rows = table(spark, sf, "lineitem").select("l_linenumber", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_shipdate")).alias("scraped_at"))
    return catalog.default_scraped_at(rows, "2024-01-01").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("scraped_at").alias("dated"), F.max("scraped_at").alias("latest"))


_PRICES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(floor(l_extendedprice) AS BIGINT) AS w, CAST(l_quantity AS BIGINT) AS c FROM lineitem)"


@query(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, w, c, CASE WHEN l_linenumber % 3 = 0 THEN (w // 1000) || '.' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(c AS VARCHAR), 2, '0') || ' EUR'
 WHEN l_linenumber % 3 = 1 THEN (w // 1000) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(c AS VARCHAR), 2, '0') ELSE w || ',' || lpad(CAST(c AS VARCHAR), 2, '0') || ' TND' END AS raw FROM {_PRICES})
 SELECT l_linenumber, count(*) AS n, count(CASE WHEN w + c / 100.0 BETWEEN 0 AND 1000000 THEN 1 END) AS parsed, round(sum(w + c / 100.0::DOUBLE), 0) AS total FROM s GROUP BY 1"""
)
def price_clean_eu_us(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    w, c, k = F.floor("l_extendedprice"), F.col("l_quantity").cast("long"), F.col("l_linenumber") % 3
    thousands, rest = F.floor(w / 1000).cast("string"), F.lpad((w % 1000).cast("string"), 3, "0")
    raw = F.when(k == 0, F.concat(thousands, F.lit("."), rest, F.lit(","), two(c), F.lit(" EUR"))).when(k == 1, F.concat(thousands, F.lit(","), rest, F.lit("."), two(c))).otherwise(F.concat(w.cast("string"), F.lit(","), two(c), F.lit(" TND")))
    return table(spark, sf, "lineitem").select("l_linenumber", prices.clean_price(raw).alias("p")).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("p").alias("parsed"), F.round(F.sum("p"), 0).alias("total"))


@query("SELECT p_partkey, p_size + 0.5::DOUBLE AS home, p_size + 0.95::DOUBLE AS abroad FROM part")
def price_shop_formats(spark, sf):
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select("p_partkey", prices.millimes_price(F.concat(size, F.lit(",500 DT"))).alias("home"), prices.decimal_comma_price(F.lit(None).cast("string"), F.concat(size, F.lit(",95 EUR"))).alias("abroad"))


# Names and specifications

_A, _B = text.accents()
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower(translate(coalesce({c}, ''), {_q(_A)}, {_q(_B)})), '[^a-z0-9\\s\\-_./]', ' ', 'g'), '\\s+', ' ', 'g'))"
_FIRST = lambda c, ps, g: "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {_q(p)}, {g}), '')" for p in ps) + ")"
_BRAND = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, {_q(chr(92) + 'b' + b + chr(92) + 'b')}) THEN {_q(b.upper())}" for b in sorted(fixed.BRANDS, key=lambda b: (-len(b), b))) + f" WHEN regexp_matches(split_part({c}, ' ', 1), '^\\pL{{3,}}$') THEN upper(split_part({c}, ' ', 1)) ELSE 'Unknown' END"
_CATEGORY = lambda c: "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({c}, {_q(w)})' for w in words)} THEN {_q(k)}" for k, words in fixed.CATEGORY_KEYWORDS.items()) + " ELSE 'Other' END"


@query(f"SELECT doc_id, md5({_NORM('text')}) AS name_md5 FROM documents")
def name_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_name(F.col("text")).cast("binary")).alias("name_md5"))


@query(f"WITH {TITLES_SQL} SELECT p_partkey, {_BRAND('lower(title)')} AS brand, {_CATEGORY('lower(title)')} AS category FROM titles")
def brand_and_category(spark, sf):
    return titles(spark, sf).select("p_partkey", text.extract_brand(F.col("title")).alias("brand"), text.categorize(F.lower("title")).alias("category"))


_STOP = "(" + "|".join(fixed.MODEL_STOPWORDS) + ")"


@query(
    f"""WITH {TITLES_SQL}, n AS (SELECT p_partkey, {_NORM('title')} AS t, {_BRAND('lower(title)')} AS b FROM titles),
 w AS (SELECT p_partkey, string_split(trim(regexp_replace(CASE WHEN b <> 'Unknown' THEN replace(t, lower(b), '') ELSE t END, '\\s+', ' ', 'g')), ' ')[1:6] AS w FROM n),
 u AS (SELECT p_partkey, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
 s AS (SELECT p_partkey, min(CASE WHEN regexp_full_match(x, {_q(_STOP)}) THEN i END) AS stop FROM u GROUP BY 1),
 g AS (SELECT u.p_partkey, x, i, row_number() OVER (PARTITION BY u.p_partkey ORDER BY i) AS k FROM u JOIN s USING (p_partkey) WHERE i < coalesce(stop, 7) AND length(x) > 1 AND regexp_matches(x, '[a-z0-9]'))
 SELECT n.p_partkey, upper(string_agg(x, ' ' ORDER BY i)) AS model FROM n LEFT JOIN g ON g.p_partkey = n.p_partkey AND k <= 3 GROUP BY 1"""
)
def model_extract(spark, sf):
    t = F.col("title")
    return titles(spark, sf).select("p_partkey", text.extract_model(text.normalize_name(t), text.extract_brand(t)).alias("model"))


_SPECS_SQL = (
    f"{TITLES_SQL}, specs AS (SELECT p_partkey, title, {_FIRST('lower(title)', fixed.PROCESSOR_PATTERNS, 0)} AS processor, {_FIRST('lower(title)', fixed.RAM_PATTERNS, 1)} || 'GB' AS ram, "
    f"upper(regexp_replace({_FIRST('lower(title)', fixed.STORAGE_PATTERNS, 0)}, '\\s+', ' ', 'g')) AS storage, {_FIRST('lower(title)', fixed.SCREEN_PATTERNS, 1)} || ' inch' AS screen FROM titles)"
)


@query(f"WITH {_SPECS_SQL} SELECT p_partkey, processor, ram, storage, screen FROM specs")
def specs_extract(spark, sf):
    return titles(spark, sf).select("p_partkey", *[c.alias(k) for k, c in text.extract_specs(F.col("title")).items()])


@query(
    f"""WITH {_SPECS_SQL} SELECT p_partkey, coalesce(nullif(substr(concat_ws('_', nullif(regexp_replace(lower({_BRAND('lower(title)')}), '[^a-z0-9]', '', 'g'), 'unknown'),
 replace(nullif(regexp_extract(lower(processor), {_q(fixed.SIGNATURE_PROCESSOR)}, 1), ''), ' ', ''), nullif(regexp_extract(ram, '(\\d+)', 1), '') || 'gb',
 nullif(regexp_extract(lower(storage), '(\\d+)\\s*(?:gb|tb)', 1), '') || CASE WHEN contains(lower(storage), 'tb') THEN 'tb' ELSE 'gb' END || CASE WHEN contains(lower(storage), 'ssd') THEN 'ssd' WHEN contains(lower(storage), 'hdd') THEN 'hdd' ELSE '' END,
 nullif(regexp_extract(screen, '(\\d+(?:\\.\\d)?)', 1), '') || 'in'), 1, 100), ''), 'unknown') AS signature FROM specs"""
)
def product_signature(spark, sf):
    t = F.col("title")
    return titles(spark, sf).select("p_partkey", text.signature(text.extract_brand(t), F.lit(None).cast("string"), text.extract_specs(t)).alias("signature"))


_T = {k: _FIRST("title", ps, 1) for k, ps in fixed.TITLE_PATTERNS.items()}


@query(f"WITH {TITLES_SQL} SELECT p_partkey, {_T['processor']} AS processor, {_T['gpu']} AS gpu, coalesce(CAST({_T['ram_gb']} AS INTEGER), -1) AS ram_gb, {_T['storage']} AS storage, {_T['screen_size']} || '\"' AS screen_size FROM titles")
def title_specs(spark, sf):
    return titles(spark, sf).select("p_partkey", *[c.alias(k) for k, c in text.title_specs(F.col("title")).items()]).fillna(-1, ["ram_gb"])


_ID = _FIRST("url", [r"/(\d+)\.html", r"/(\d+)-", r"/p/(\d+)"], 1)


@query(f"SELECT page_id, coalesce({_ID}, substr(md5(url), 1, 8)) AS product_id, {' OR '.join(f'contains(lower(html), {_q(w)})' for w in fixed.BLOCK_INDICATORS)} AS blocked FROM pages")
def product_id_and_blocked(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.product_id_from_url(F.col("url")).alias("product_id"), text.is_blocked(F.col("html")).alias("blocked"))


_HTML = "regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"


@query(
    f"SELECT page_id, coalesce({_ID}, substr(md5(url), 1, 8)) AS product_id, coalesce({' OR '.join(f'contains(lower(html), {_q(w)})' for w in fixed.BLOCK_INDICATORS)}, false) AS blocked, trim(regexp_extract({_HTML}, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, "
    f"CAST(len(regexp_extract_all({_HTML}, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all({_HTML}, '(?i)<p[\\s>]')) AS BIGINT) AS n_paragraphs FROM pages"
)
def page_records(spark, sf):
    return pages.page_records(table(spark, sf, "pages"))


@query("WITH n AS (SELECT p_size AS listing, p_partkey AS page, p_partkey % 7 AS items FROM part), s AS (SELECT listing, min(CASE WHEN items = 0 THEN page END) AS stop FROM n GROUP BY 1) SELECT listing, page, 'x?page=' || page AS url FROM n JOIN s USING (listing) WHERE stop IS NULL OR page < stop")
def pagination(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_size").alias("listing"), F.col("p_partkey").alias("page"), (F.col("p_partkey") % 7).alias("items"))
    return pages.until_first_empty(rows, "listing", "page", "items").select("listing", "page", pages.page_url(F.lit("x"), F.col("page"), "query").alias("url"))


# Statistics


def _counts(column: str) -> str:
    return f"SELECT {column} AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM offers WHERE {column} IS NOT NULL GROUP BY 1"


@query(f"WITH {OFFERS_SQL} {_counts('category')}")
def value_counts_pct(spark, sf):
    return stats.value_counts(offers(spark, sf), "category")


@query(f"WITH {OFFERS_SQL} {_counts('brand')} ORDER BY n DESC, value LIMIT 10")
def top_brands(spark, sf):
    return stats.top_values(offers(spark, sf), "brand").where("value <> 'Unknown' and value <> ''")


@query(f"WITH {OFFERS_SQL} SELECT country, count(*) AS n, round(avg(price_value), 4) AS mean, round(median(price_value), 4) AS med, min(price_value) AS lo, max(price_value) AS hi, round(stddev_samp(price_value), 4) AS std FROM offers GROUP BY 1")
def price_stats_by_market(spark, sf):
    p = "price_value"
    rows = offers(spark, sf)
    out = rows.groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.round(F.stddev_samp(p), 4).alias("std"))
    return with_quantiles(out, quantiles(rows, p, (0.5,), ["country"]), ["country"]).withColumn("med", F.round("q0", 4)).drop("q0")


_DOCS = "(SELECT doc_id, text, lang, quality FROM documents LEFT JOIN labels USING (doc_id))"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 4) AS pct FROM {_DOCS}" for c in ("doc_id", "text", "lang", "quality")))
def missing_by_column(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return stats.missing_by_column(docs)


@query(f"SELECT round(1 - (4 * count(*) - count(doc_id) - count(text) - count(lang) - count(quality)) / (4.0 * count(*)), 6) AS completeness, round(1 - count(CASE WHEN lower(text) = 'invalid' OR lower(lang) = 'invalid' THEN 1 END) / (4.0 * count(*)), 6) AS validity, round(count(DISTINCT doc_id) * 1.0 / count(*), 6) AS consistency FROM {_DOCS}")
def data_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return monitoring.quality_scores(docs, "doc_id")


_DESCRIBE = lambda c, by="": f"SELECT {by}count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max"


@query(f"WITH {OFFERS_SQL} {_DESCRIBE('price_value')} FROM offers")
def describe_prices(spark, sf):
    return stats.describe(offers(spark, sf), "price_value")


@query(f"WITH {REVIEWS_SQL}, r AS (SELECT is_fake, CAST(length(text) AS DOUBLE) AS n_chars FROM reviews) {_DESCRIBE('n_chars', 'is_fake, ')} FROM r GROUP BY is_fake")
def describe_by_label(spark, sf):
    return stats.describe(review_rows(spark, sf).withColumn("n_chars", F.char_length("text").cast("double")), "n_chars", ["is_fake"])


@query(f"WITH {OFFERS_SQL} SELECT country, currency, count(*) AS n FROM offers GROUP BY ALL")
def country_currency_counts(spark, sf):
    return offers(spark, sf).groupBy("country", "currency").agg(F.count("*").alias("n"))


@query(f"WITH {REVIEWS_SQL} SELECT is_fake, " + ", ".join(f"count(CASE WHEN rating = {i} THEN 1 END) AS r{i}" for i in range(1, 6)) + " FROM reviews GROUP BY 1")
def label_rating_pivot(spark, sf):
    out = review_rows(spark, sf).groupBy("is_fake").pivot("rating", [1, 2, 3, 4, 5]).count().fillna(0)
    return out.withColumnsRenamed({str(i): f"r{i}" for i in range(1, 6)})


@query(f"WITH {OFFERS_SQL}, e AS (SELECT min(price_value) AS lo, max(price_value) AS hi FROM offers) SELECT CAST(least(floor((price_value - lo) * 30 / (hi - lo)) + 1, 30) AS BIGINT) AS bin, count(*) AS n FROM offers, e GROUP BY 1")
def price_histogram(spark, sf):
    return stats.histogram(offers(spark, sf), "price_value", 30)


# Markets

_SIDES_SQL = f"{OFFERS_SQL}, sides AS (SELECT category, country, {_EUR} AS eur FROM offers)"


def _eur(df: DataFrame) -> DataFrame:
    return df.withColumn("eur", F.col("price_value") * F.when(F.col("currency") == "EUR", 1.0).otherwise(prices.rate(F.col("currency"), "EUR")))


@query(f"WITH {OFFERS_SQL} SELECT currency, count(*) AS n, round(sum({_EUR}), 0) AS eur FROM offers GROUP BY 1")
def currency_convert(spark, sf):
    return _eur(offers(spark, sf)).groupBy("currency").agg(F.count("*").alias("n"), F.round(F.sum("eur"), 0).alias("eur"))


@query(
    f"WITH {_SIDES_SQL}, m AS (SELECT category, avg(CASE WHEN country = 'Tunisia' THEN eur END) AS home, avg(CASE WHEN country = 'France' THEN eur END) AS abroad FROM sides GROUP BY 1) "
    "SELECT category, round(home, 4) AS home_eur, round(abroad, 4) AS abroad_eur, round(home - abroad, 2) AS price_diff_eur, round((home - abroad) / abroad * 100, 2) AS price_diff_pct, CASE WHEN home - abroad > 0 THEN 'France' ELSE 'Tunisia' END AS cheaper_country, round(abs(home - abroad), 2) AS savings_eur FROM m"
)
def price_by_category(spark, sf):
    side = lambda c: F.avg(F.when(F.col("country") == c, F.col("eur")))
    rows = _eur(offers(spark, sf)).groupBy("category").agg(side("Tunisia").alias("home"), side("France").alias("abroad"))
    return rows.select("category", F.round("home", 4).alias("home_eur"), F.round("abroad", 4).alias("abroad_eur"), *[c.alias(k) for k, c in prices.comparison(F.col("home"), F.col("abroad")).items()])


_PAIRS_SQL = (
    f"{OFFERS_SQL}, m AS (SELECT part_key, category, min(product_name) AS product_name, min(CASE WHEN country = 'Tunisia' THEN {_EUR} END) AS home, min(CASE WHEN country = 'France' THEN {_EUR} END) AS abroad FROM offers GROUP BY part_key, category), "
    "pairs AS (SELECT *, home - abroad AS diff, round((home - abroad) / abroad * 100, 4) AS pct FROM m WHERE home IS NOT NULL AND abroad IS NOT NULL)"
)


def _pairs(spark, sf) -> DataFrame:
    low = lambda c: F.min(F.when(F.col("country") == c, F.col("eur")))
    rows = _eur(offers(spark, sf)).groupBy("part_key", "category").agg(F.min("product_name").alias("product_name"), low("Tunisia").alias("home"), low("France").alias("abroad")).where("home is not null and abroad is not null")
    return rows.withColumn("diff", F.col("home") - F.col("abroad")).withColumn("pct", F.round(F.col("diff") / F.col("abroad") * 100, 4))


@query(f"WITH {_PAIRS_SQL} SELECT category, count(*) AS n, round(avg(pct), 2) AS mean, round(median(pct), 2) AS med, round(min(pct), 2) AS lo, round(max(pct), 2) AS hi, count(CASE WHEN diff > 0 THEN 1 END) AS abroad_cheaper FROM pairs GROUP BY 1")
def diff_by_category(spark, sf):
    rows = _pairs(spark, sf)
    out = rows.groupBy("category").agg(F.count("*").alias("n"), *[F.round(f("pct"), 2).alias(a) for a, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))], F.count_if(F.col("diff") > 0).alias("abroad_cheaper"))
    return with_quantiles(out, quantiles(rows, "pct", (0.5,), ["category"]), ["category"]).withColumn("med", F.round("q0", 2)).drop("q0")


@query(f"WITH {_PAIRS_SQL} SELECT part_key, substr(product_name, 1, 40) AS product_name, round(abs(diff), 4) AS savings_eur FROM pairs ORDER BY abs(diff) DESC, part_key LIMIT 10")
def top_savings(spark, sf):
    return _pairs(spark, sf).orderBy(F.abs("diff").desc(), "part_key").limit(10).select("part_key", F.substring("product_name", 1, 40).alias("product_name"), F.round(F.abs("diff"), 4).alias("savings_eur"))


def _market(spark, sf, country: str, key: str) -> DataFrame:
    rows = offers(spark, sf).where(F.col("country") == country).select(F.col("part_key").alias(key), F.col("product_name").alias("name"), "brand", "category").distinct()
    return rows.withColumn("signature", F.concat_ws("_", F.lower("brand"), F.lower("name"))).withColumn("specs", F.create_map(F.lit("type"), F.col("category"), F.lit("brand"), F.col("brand")))


_MARKETS_SQL = f"{OFFERS_SQL}, l AS (SELECT DISTINCT part_key AS left_id, product_name AS name, brand, category, lower(brand) || '_' || lower(product_name) AS signature FROM offers WHERE country = 'Tunisia'), r AS (SELECT DISTINCT part_key AS right_id, product_name AS name, brand, category, lower(brand) || '_' || lower(product_name) AS signature FROM offers WHERE country = 'France')"
_EXACT_SQL = f"{_MARKETS_SQL}, f AS (SELECT signature, min(right_id) AS right_id FROM r GROUP BY 1), e AS (SELECT left_id, f.right_id, 100 AS score FROM l JOIN f USING (signature))"


@query(f"WITH {_EXACT_SQL} SELECT * FROM e")
def match_exact_signature(spark, sf):
    return matching.exact_matches(_market(spark, sf, "Tunisia", "left_id"), _market(spark, sf, "France", "right_id"))


@query(f"WITH {_EXACT_SQL} SELECT left_id FROM l WHERE left_id NOT IN (SELECT left_id FROM e)")
def exact_unmatched_left(spark, sf):
    left = _market(spark, sf, "Tunisia", "left_id")
    return matching.unmatched(left, matching.exact_matches(left, _market(spark, sf, "France", "right_id")), "left_id").select("left_id")


@query(f"WITH {_EXACT_SQL} SELECT right_id FROM r WHERE right_id NOT IN (SELECT right_id FROM e)")
def exact_unmatched_right(spark, sf):
    right = _market(spark, sf, "France", "right_id")
    return matching.unmatched(right, matching.exact_matches(_market(spark, sf, "Tunisia", "left_id"), right), "right_id").select("right_id")


@query(f"WITH {_MARKETS_SQL}, p AS (SELECT left_id, right_id, CASE WHEN l.category = r.category THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS score FROM l JOIN r USING (brand)) SELECT left_id, min(right_id) AS right_id, 100.0::DOUBLE AS score FROM p WHERE score > 70 GROUP BY left_id")
def match_specs(spark, sf):
    return matching.specs_matches(_market(spark, sf, "Tunisia", "left_id"), _market(spark, sf, "France", "right_id"))


_SORTED = lambda c: f"array_to_string(list_sort(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ')), ' ')"


def fuzzy_sql(left: str, right: str, name: str, accept: int = matching.ACCEPT) -> str:
    """CTEs ending in ``best`` (tokens, right_id, score): for each distinct name of ``left`` its best of ``right``, by a
    longest common subsequence whose state is one wide integer (names of up to 120 characters)."""
    return f"""fl AS (SELECT DISTINCT {_SORTED(name)} AS a FROM {left}), fr AS (SELECT {_SORTED(name)} AS b, min(right_id) AS right_id FROM {right} GROUP BY 1),
 chars AS (SELECT a, unnest(string_split(a, '')) AS c, generate_subscripts(string_split(a, ''), 1) AS i FROM fl WHERE a <> ''),
 bits AS (SELECT a, c, sum(1::HUGEINT << CAST(i - 1 AS HUGEINT))::HUGEINT AS bit FROM chars GROUP BY ALL),
 masks AS (SELECT a, map(list(c), list(bit)) AS m, (1::HUGEINT << CAST(length(a) AS HUGEINT)) - 1 AS whole FROM bits GROUP BY a),
 states AS (SELECT a, b, right_id, list_reduce(list_prepend(whole, list_transform(string_split(b, ''), lambda c: coalesce(m[c], 0::HUGEINT))), lambda r, u: ((r + (r & u)) | (r - (r & u))) & whole) AS state
 FROM masks, fr WHERE b <> '' AND least(length(a), length(b)) >= {(accept - 0.5) / 200} * (length(a) + length(b))),
 scored AS (SELECT a, right_id, CAST(round_even(200.0 * (length(a) - bit_count(state)) / (length(a) + length(b)), 0) AS INTEGER) AS score FROM states),
 best AS (SELECT a AS tokens, arg_min(right_id, (-score, right_id)) AS right_id, max(score) AS score FROM scored WHERE score >= {accept} GROUP BY a)"""


_FUZZY_SQL = f"{_EXACT_SQL}, {fuzzy_sql('l', 'r', 'name')}"


@query(f"WITH {_FUZZY_SQL} SELECT left_id, best.right_id, score FROM l JOIN best ON tokens = {_SORTED('name')}")
def match_fuzzy(spark, sf):
    return matching.fuzzy_matches(_market(spark, sf, "Tunisia", "left_id"), _market(spark, sf, "France", "right_id"))


_PARTS_SPECS_SQL = "sp AS (SELECT left_id, min(r.right_id) AS right_id, 100.0::DOUBLE AS score FROM l JOIN r USING (brand, category) WHERE left_id NOT IN (SELECT left_id FROM e) GROUP BY 1)"


def cascade_sql(exact: str, fuzzy: str, specs: str) -> str:
    """The pick of a cascade from tables (left_id, right_id, score) of its levels; ``fuzzy`` and ``specs`` may hold more left rows than are open."""
    return f"""tried AS (SELECT left_id, right_id, CAST(score AS DOUBLE) AS score, 'exact' AS method FROM {exact} UNION ALL SELECT left_id, right_id, CAST(score AS DOUBLE), 'fuzzy' FROM {fuzzy} WHERE left_id NOT IN (SELECT left_id FROM {exact})
 UNION ALL SELECT left_id, right_id, score, 'specs' FROM {specs} WHERE left_id NOT IN (SELECT left_id FROM {exact}) AND left_id NOT IN (SELECT left_id FROM {fuzzy} WHERE score >= 85)),
 picked AS (SELECT *, CASE WHEN score >= 85 THEN 'high' ELSE 'medium' END AS confidence FROM tried WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, method, right_id) = 1)"""


@query(f"WITH {_FUZZY_SQL}, fz AS (SELECT left_id, best.right_id, score FROM l JOIN best ON tokens = {_SORTED('name')}), {_PARTS_SPECS_SQL}, {cascade_sql('e', 'fz', 'sp')} SELECT left_id, right_id, score, method, confidence FROM picked")
def match_cascade(spark, sf):
    return matching.match_cascade(_market(spark, sf, "Tunisia", "left_id"), _market(spark, sf, "France", "right_id"))


@query(f"WITH {_EXACT_SQL} SELECT (SELECT count(*) FROM l) AS products, count(*) AS matches, round(count(*) * 100.0 / (SELECT count(*) FROM l), 4) AS match_rate, count(CASE WHEN score >= 85 THEN 1 END) AS high, count(CASE WHEN score >= 70 AND score < 85 THEN 1 END) AS medium FROM e")
def exact_tiers_and_rate(spark, sf):
    left = _market(spark, sf, "Tunisia", "left_id")
    found = matching.exact_matches(left, _market(spark, sf, "France", "right_id"))
    tiers = found.agg(F.count("*").alias("matches"), F.count_if(matching.confidence(F.col("score")) == "high").alias("high"), F.count_if(matching.confidence(F.col("score")) == "medium").alias("medium"))
    return left.agg(F.count("*").alias("products")).crossJoin(F.broadcast(tiers)).select("products", "matches", F.round(F.col("matches") * 100.0 / F.col("products"), 4).alias("match_rate"), "high", "medium")


@query("WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(p_type || ' ' || p_name), ' '), lambda x: x <> '')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS similarity FROM w")
def token_jaccard(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(text.token_jaccard(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("similarity"))


# Reviews

_CLEAN = "lower(coalesce(text, ''))"
for _p, _by in ((r"http\S+|www\S+", ""), (r"\S+@\S+", ""), (r"<.*?>", ""), (r"[^a-z0-9\s.!?,']", " "), (r"\s+", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, {_q(_p)}, '{_by}', 'g')"


@query(f"SELECT doc_id, md5(trim({_CLEAN})) AS clean_md5 FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean_review(F.col("text")).cast("binary")).alias("clean_md5"))


_COUNT = lambda p: f"CAST(len(regexp_extract_all(t, {_q(p)})) AS BIGINT)"


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM d), a AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]+')) AS alpha, CAST(len(w) AS BIGINT) AS n, length(t) AS chars FROM w)
 SELECT doc_id, chars AS text_length, n AS word_count, round(chars / CAST(greatest(n, 1) AS DOUBLE), 6) AS avg_word_length, {_COUNT('!')} AS exclamation_count, {_COUNT('[?]')} AS question_count, round({_COUNT('[A-Z]')} / CAST(greatest(chars, 1) AS DOUBLE), 6) AS capital_ratio, {_COUNT('[0-9]')} AS digit_count,
 round(len(list_distinct(alpha)) / CAST(greatest(len(alpha), 1) AS DOUBLE), 6) AS unique_word_ratio, greatest({_COUNT('[.!?]')}, 1) AS sentence_count, CAST(n < 20 AS INTEGER) AS is_very_short, CAST(n > 150 AS INTEGER) AS is_very_long FROM a"""
)
def text_features(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in text.review_features(F.col("text"), ascii_only=True).items()])


@query("SELECT doc_id, CASE WHEN length(replace(coalesce(text, ''), ' ', '')) = 0 THEN 'unknown' WHEN len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]')) / length(replace(text, ' ', '')) > 0.3 THEN 'ar' WHEN " + " + ".join(f"CAST(contains(lower(text), {_q(w)}) AS INTEGER)" for w in fixed.FRENCH_WORDS) + " > 2 THEN 'fr' ELSE 'en' END AS detected FROM documents")
def detect_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.detect_language(F.col("text")).alias("detected"))


@query("SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS lang_index FROM documents WHERE lang IS NOT NULL")
def label_encode(spark, sf):
    docs = table(spark, sf, "documents").where("lang is not null").select("doc_id", "lang")
    return reviews.label_encode(docs, "lang").select("doc_id", "lang_index")


@query(f"WITH {REVIEWS_SQL} SELECT doc_id, is_fake, CASE WHEN row_number() OVER (PARTITION BY is_fake ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY is_fake) * 0.8) THEN 'train' ELSE 'test' END AS part FROM reviews")
def stratified_split(spark, sf):
    return reviews.stratified_split(review_rows(spark, sf).select("doc_id", "is_fake"), "doc_id", "is_fake").select("doc_id", "is_fake", "part")


@query(f"WITH {REVIEWS_SQL}, r AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS x FROM reviews) SELECT doc_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 4) AS x FROM r")
def standard_scale(spark, sf):
    return reviews.standard_scale(review_rows(spark, sf).select("doc_id", F.char_length("text").cast("double").alias("x")), ["x"])


@query(f"WITH {REVIEWS_SQL} SELECT 'n_chars' AS feature, round(corr(CAST(length(text) AS DOUBLE), CAST(is_fake AS DOUBLE)), 6) AS correlation FROM reviews UNION ALL SELECT 'rating', round(corr(CAST(rating AS DOUBLE), CAST(is_fake AS DOUBLE)), 6) FROM reviews")
def feature_correlation(spark, sf):
    rows = review_rows(spark, sf).select(F.char_length("text").cast("double").alias("n_chars"), F.col("rating").cast("double").alias("rating"), F.col("is_fake").cast("double").alias("y"))
    return stats.pearson(rows, ["n_chars", "rating"], "y")


@query(f"WITH {REVIEWS_SQL}, s AS (SELECT is_fake, count(*) AS n, avg(length(text)) AS m, var_samp(length(text)) AS v FROM reviews GROUP BY 1) SELECT round(a.m, 4) AS mean_a, round(b.m, 4) AS mean_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 4) AS t FROM s a, s b WHERE a.is_fake = 1 AND b.is_fake = 0")
def ttest_text_length(spark, sf):
    return stats.pooled_t(review_rows(spark, sf).select(F.char_length("text").alias("x"), "is_fake"), "x", F.col("is_fake") == 1)


_ENSEMBLE_SQL = SCORES_SQL + ", ens AS (SELECT *, round(0.45::DOUBLE * xgboost_score + 0.55::DOUBLE * bert_score, 6) AS ensemble_score, round(abs(xgboost_score - bert_score), 6) AS gap FROM scores), done AS (SELECT *, CASE WHEN gap < 0.1 THEN 'high' WHEN gap < 0.3 THEN 'medium' ELSE 'low' END AS confidence, CAST(ensemble_score > 0.5 AS INTEGER) AS is_fake_predicted FROM ens)"


def _scored(spark, sf) -> DataFrame:
    return reviews.ensemble(scores(review_rows(spark, sf)))


@query(f"WITH {_ENSEMBLE_SQL} SELECT doc_id, ensemble_score, confidence, is_fake_predicted FROM done")
def ensemble_score(spark, sf):
    return _scored(spark, sf).select("doc_id", "ensemble_score", "confidence", "is_fake_predicted")


@query(f"WITH {_ENSEMBLE_SQL} SELECT confidence, count(*) AS n, CAST(sum(is_fake_predicted) AS BIGINT) AS fake, round(avg(xgboost_score), 4) AS xgb, round(avg(bert_score), 4) AS bert, round(stddev_samp(ensemble_score), 4) AS std FROM done GROUP BY 1")
def score_stats(spark, sf):
    return _scored(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"), F.sum("is_fake_predicted").alias("fake"), F.round(F.avg("xgboost_score"), 4).alias("xgb"), F.round(F.avg("bert_score"), 4).alias("bert"), F.round(F.stddev_samp("ensemble_score"), 4).alias("std"))


@query(f"WITH {_ENSEMBLE_SQL} SELECT r.rating, coalesce(n, 0) AS fake FROM (VALUES (1), (2), (3), (4), (5)) r(rating) LEFT JOIN (SELECT rating, count(*) AS n FROM done WHERE is_fake_predicted = 1 GROUP BY 1) f USING (rating)")
def fake_by_rating(spark, sf):
    axis = spark.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    counts = _scored(spark, sf).where("is_fake_predicted = 1").groupBy("rating").agg(F.count("*").alias("n"))
    return axis.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("fake"))


@query(f"WITH {_ENSEMBLE_SQL} SELECT doc_id, substr(text, 1, 50) AS start, ensemble_score FROM done ORDER BY ensemble_score DESC, doc_id LIMIT 10")
def top_fakes(spark, sf):
    return _scored(spark, sf).orderBy(F.col("ensemble_score").desc(), "doc_id").limit(10).select("doc_id", F.substring("text", 1, 50).alias("start"), "ensemble_score")


@query(f"WITH {_ENSEMBLE_SQL} SELECT is_fake, is_fake_predicted, count(*) AS n FROM done GROUP BY ALL")
def confusion_matrix(spark, sf):
    return reviews.confusion(_scored(spark, sf), "is_fake", "is_fake_predicted")


@query(f"WITH {_ENSEMBLE_SQL}, b AS (SELECT ensemble_score, sum(is_fake) AS p, sum(1 - is_fake) AS q FROM done GROUP BY 1) SELECT ensemble_score, CAST(sum(p) OVER (ORDER BY ensemble_score DESC) AS BIGINT) AS tp, CAST(sum(q) OVER (ORDER BY ensemble_score DESC) AS BIGINT) AS fp FROM b")
def roc_points(spark, sf):
    return reviews.roc_points(_scored(spark, sf), "is_fake", "ensemble_score")


@query(
    f"""WITH {_ENSEMBLE_SQL}, c AS (SELECT count(CASE WHEN is_fake = 1 AND is_fake_predicted = 1 THEN 1 END) AS tp, count(CASE WHEN is_fake = 0 AND is_fake_predicted = 1 THEN 1 END) AS fp, count(CASE WHEN is_fake = 1 AND is_fake_predicted = 0 THEN 1 END) AS fn, count(*) AS n FROM done),
 r AS (SELECT is_fake, rank() OVER (ORDER BY ensemble_score) + (count(*) OVER (PARTITION BY ensemble_score) - 1) / 2.0 AS k FROM done),
 u AS (SELECT (sum(CASE WHEN is_fake = 1 THEN k END) - count(CASE WHEN is_fake = 1 THEN 1 END) * (count(CASE WHEN is_fake = 1 THEN 1 END) + 1) / 2.0) / (count(CASE WHEN is_fake = 1 THEN 1 END) * 1.0 * count(CASE WHEN is_fake = 0 THEN 1 END)) AS auc FROM r)
 SELECT round((n - fp - fn) / CAST(n AS DOUBLE), 6) AS accuracy, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1, round(auc, 6) AS auc FROM c, u"""
)
def model_metrics(spark, sf):
    return reviews.metrics(_scored(spark, sf), "is_fake", "is_fake_predicted", "ensemble_score")


# Models fitted by MLlib: no SQL; tests hold them against planted labels


def _trained(spark, sf, kind: str):
    """The model and its rows, whose features are written once: fitting reads them again and again."""
    rows = training.with_features(reviews.stratified_split(review_rows(spark, sf), "doc_id", "is_fake"))
    rows = staged(rows.select("doc_id", "part", "is_fake", *training.FEATURES))
    return training.fit(rows.where("part = 'train'"), kind, "is_fake"), rows


def _held_out_metrics(spark, sf, kind: str) -> DataFrame:
    model, rows = _trained(spark, sf, kind)
    answers = staged(training.predict(model, rows.where("part = 'test'")).select("is_fake", "predicted", "score"))
    return reviews.metrics(answers, "is_fake", "predicted", "score")


@query()
def logreg_train(spark, sf):
    return _held_out_metrics(spark, sf, "logreg")


@query()
def gbt_train(spark, sf):
    return _held_out_metrics(spark, sf, "boosted")


@query()
def rf_train(spark, sf):
    return _held_out_metrics(spark, sf, "forest")


@query()
def rf_importance(spark, sf):
    return training.importances(_trained(spark, sf, "forest")[0], spark)


# Exports, registry, monitoring


@query("SELECT p_partkey, p_name, CASE WHEN p_type IN (" + ", ".join(_q(c) for c in fixed.CATEGORIES) + ") THEN 'x' ELSE 'cat_000008' END AS category_id, CAST(p_retailprice AS DOUBLE) AS price, true AS in_stock FROM part")
def export_products(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_type").alias("category"), F.col("p_retailprice").cast("double").alias("price"))
    return export.with_category_id(rows, export.categories(spark, fixed.CATEGORIES)).select("p_partkey", "p_name", "category_id", "price", F.lit(True).alias("in_stock"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS j FROM part), n AS (SELECT least((SELECT count(*) FROM r), (SELECT count(*) FROM p)) AS n) SELECT doc_id, p_partkey FROM r, n, p WHERE j = i % n")
def export_reviews_round_robin(spark, sf):
    return export.round_robin(table(spark, sf, "documents"), table(spark, sf, "part"), "doc_id", "p_partkey")


@query("WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS v FROM part ORDER BY 1 LIMIT 50), d AS (SELECT * FROM p, (VALUES (30), (21), (14), (7), (0)) t(days_ago)) SELECT p_partkey, days_ago, round(v * (1 + (CAST('0x' || substr(md5('history:' || p_partkey || ':' || days_ago), 1, 6) AS BIGINT) / 16777215.0::DOUBLE * 0.1::DOUBLE - 0.05::DOUBLE)), 4) AS price FROM d")
def price_history(spark, sf):
    return export.price_history(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v")), "p_partkey", "v")


@query(f"WITH {VERSIONS_SQL} SELECT name, version, stage FROM versions QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1")
def registry_latest(spark, sf):
    return lifecycle.latest(versions(spark, sf))


@query(f"WITH {VERSIONS_SQL}, m AS (SELECT *, max(CASE WHEN stage = 'Staging' THEN version END) OVER (PARTITION BY name) AS s, max(CASE WHEN stage = 'Production' THEN version END) OVER (PARTITION BY name) AS p FROM versions) SELECT name, version, CASE WHEN version = s THEN 'Production' WHEN s IS NOT NULL AND version = p THEN 'Archived' ELSE stage END AS stage FROM m")
def registry_promote(spark, sf):
    return lifecycle.promote(versions(spark, sf)).select("name", "version", "stage")


@query(f"WITH {VERSIONS_SQL} SELECT name, version, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY version DESC) > 3 THEN 'Archived' ELSE stage END AS stage FROM versions")
def registry_cleanup(spark, sf):
    return lifecycle.keep_last(versions(spark, sf)).select("name", "version", "stage")


@query(f"WITH {VERSIONS_SQL} SELECT name, coalesce('models:/' || name || '/' || max(CASE WHEN stage = 'Production' THEN version END), 'local') AS uri FROM versions GROUP BY name")
def registry_serving(spark, sf):
    return lifecycle.serving(versions(spark, sf))


@query(f"WITH {RUNS_SQL} SELECT state, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM runs WHERE CAST(end_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def runs_dashboard(spark, sf):
    return monitoring.dashboard(run_rows(spark, sf), "2024-01-05", "2024-01-20")


@query(f"WITH {RUNS_SQL} SELECT CAST(CAST(end_time AS DATE) AS VARCHAR) AS day, count(*) AS total, count(CASE WHEN state = 'failed' THEN 1 END) AS failed, count(CASE WHEN duration > 50 THEN 1 END) AS slow, round(avg(duration), 4) AS avg_duration FROM runs GROUP BY 1")
def daily_report(spark, sf):
    return monitoring.daily_report(run_rows(spark, sf), 50.0).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {RUNS_SQL} SELECT date_trunc('hour', end_time) AS window_start, count(*) AS failures FROM runs WHERE state = 'failed' GROUP BY 1 HAVING count(*) > 3")
def failure_storm(spark, sf):
    return monitoring.failure_storms(run_rows(spark, sf))


@query(f"WITH {RUNS_SQL}, d AS (SELECT CAST(end_time AS DATE) AS day, count(*) AS n FROM runs GROUP BY 1), r AS (SELECT *, round(avg(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS rolling FROM d) SELECT CAST(day AS VARCHAR) AS day, n, rolling FROM r WHERE abs(n - rolling) > 1")
def rolling_volume_anomaly(spark, sf):
    return monitoring.rolling_anomalies(run_rows(spark, sf), 1.0).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {RUNS_SQL} SELECT state, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99 FROM runs GROUP BY 1")
def latency_percentiles(spark, sf):
    return monitoring.percentiles(run_rows(spark, sf), "state", "duration")


@query("WITH m AS (SELECT event_type, avg(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN value END) AS a, avg(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value END) AS b FROM events GROUP BY 1), d AS (SELECT round(avg(abs(b - a) / abs(a)), 4) AS drift FROM m WHERE a IS NOT NULL AND b IS NOT NULL) SELECT drift, drift > 0.15 AS alert FROM d")
def drift_score(spark, sf):
    side = lambda c: table(spark, sf, "events").where(c).groupBy("event_type").agg(F.avg("value").alias("v"))
    return monitoring.drift(side("ts < timestamp '2024-01-15'"), side("ts >= timestamp '2024-01-15'"), "event_type", "v")


@query(f"WITH {RUNS_SQL}, m AS (SELECT round(count(CASE WHEN state = 'completed' THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS s, round(avg(duration), 4) AS d, CAST(count(*) AS DOUBLE) AS n FROM runs) SELECT 'success_rate' AS name, s AS value, 0.95::DOUBLE AS bound, s >= 0.95 AS ok FROM m UNION ALL SELECT 'duration', d, 60.0::DOUBLE, d <= 60 FROM m UNION ALL SELECT 'volume', n, 300.0::DOUBLE, n >= 300 FROM m")
def sla_check(spark, sf):
    return monitoring.sla({"success_rate": (F.count_if(F.col("state") == "completed") / F.count("*"), "min", 0.95), "duration": (F.avg("duration"), "max", 60), "volume": (F.count("*").cast("double"), "min", 300)}, run_rows(spark, sf))


@query("WITH e AS (SELECT event_id, ['Timeout after 5s', 'HTTP 403', 'Connection reset', 'bad parse'][event_id % 4 + 1] AS m FROM events) SELECT event_id, CASE WHEN contains(lower(m), 'timeout') THEN 'timeout' WHEN contains(lower(m), '403') OR contains(lower(m), '401') THEN 'credentials' WHEN contains(lower(m), 'connection') THEN 'network' ELSE 'scraper' END AS kind FROM e")
def error_classification(spark, sf):
    said = F.element_at(F.array(*[F.lit(m) for m in ("Timeout after 5s", "HTTP 403", "Connection reset", "bad parse")]), (F.col("event_id") % 4).cast("int") + 1)
    return table(spark, sf, "events").select("event_id", monitoring.classify_error(said).alias("kind"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return tumbling(table(spark, sf, "events"))


from . import markets, operations, scoring  # noqa: E402, F401, I001
from . import alerting  # noqa: E402, F401, I001  takes SQL of the others
