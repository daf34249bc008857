"""Acquisition, exports, model registry, experiment log and data-quality alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, prices, text
from ..operators import export, lifecycle, monitoring, stats
from ..sources import files, pages
from ..sources.markup import select_items
from ..sources.tables import RUNS_SQL, VERSIONS_SQL, table, versions
from ..sources.tables import runs as run_rows
from .queries import _FIRST
from .registry import query, quoted

# Result pages of shops: items written as HTML, twenty to a page and by turns in three ways, and read back

_OPEN = ["<article data-product-id=\"{id}\">", "<li class=\"item product-item\" data-product-id=\"{id}\">", "<div class=\"product-container\" data-product-id=\"{id}\">"]
_CLOSE = ["</article>", "</li>", "</div>"]


def _result_pages(spark, sf) -> DataFrame:
    """(page, html) of all parts: twenty items to a page."""
    n, page = F.col("p_partkey"), F.floor(F.col("p_partkey") / 20)
    style = (page % 3).cast("int") + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), style)
    whole = F.floor("p_retailprice").cast("string")
    item = F.concat(
        F.replace(pick(_OPEN), F.lit("{id}"), n.cast("string")),
        F.when(n % 13 != 0, F.concat(F.lit('<h2><a href="'), F.when(n % 2 == 0, "https://shop.example/").otherwise("/"), n.cast("string"), F.lit('.html"> '), "p_name", F.lit(" </a></h2>"))).otherwise(""),
        F.lit('<div class="price-box"><span class="final-price">'), whole, F.lit(",000 DT</span>"),
        F.when(n % 3 == 0, F.concat(F.lit('<span class="original-price">'), (F.floor("p_retailprice") + 100).cast("string"), F.lit(",000 DT</span>"))).otherwise(""), F.lit("</div>"),
        F.when(n % 5 != 0, F.concat(F.lit('<img class="brand" alt="'), "p_brand", F.lit('"/>'))).otherwise(""),
        F.when(n % 4 == 0, '<p class="stock">Épuisé</p>').when(n % 4 == 1, '<p class="stock">En <b>stock</b></p>').otherwise(""),
        F.lit('<img class="photo" '), F.when(n % 2 == 0, "src").otherwise("data-src"), F.lit('="img/'), n.cast("string"), F.lit('.jpg"/><span class="sku">S'), n.cast("string"), F.lit("</span>"),
        pick(_CLOSE),
    )
    rows = table(spark, sf, "part").select(page.alias("page"), n.alias("n"), item.alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"])  # twenty at most
    return rows.groupBy("page").agg(F.concat(F.lit("<html><body><h1>Results</h1>"), F.array_join(listed, "\n"), F.lit("</body></html>")).alias("html"))


_RECORDS_SQL = """records AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, floor(p_retailprice) AS price, CASE WHEN p_partkey % 3 = 0 THEN floor(p_retailprice) + 100 END AS regular_price, CASE WHEN p_partkey % 3 = 0 THEN round(100 / (floor(p_retailprice) + 100) * 100, 2) ELSE 0 END AS discount_percent,
 CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, 'S' || p_partkey AS sku, 'https://shop.example/' || p_partkey || '.html' AS url, 'img/' || p_partkey || '.jpg' AS image, CAST(NULL AS VARCHAR) AS description, p_partkey % 4 <> 0 AS in_stock FROM part WHERE p_partkey % 13 <> 0)"""


def _records(spark, sf) -> DataFrame:
    return pages.product_records(_result_pages(spark, sf), "page", "https://shop.example", "shop_tn", title="h2 > a", url="h2 > a@href", brand="img.brand@alt", image="img.photo@src", image_later="img.photo@data-src")


@query(f"WITH {_RECORDS_SQL} SELECT * FROM records")
def shop_page_records(spark, sf):
    return _records(spark, sf).select("id", "title", "price", "regular_price", "discount_percent", "brand", "sku", "url", "image", "description", "in_stock")


@query(f"WITH {_RECORDS_SQL} SELECT count(*) AS items, count(CASE WHEN in_stock THEN 1 END) AS in_stock, count(CASE WHEN NOT in_stock THEN 1 END) AS out_of_stock, count(CASE WHEN discount_percent > 0 THEN 1 END) AS discounted, round(avg(CASE WHEN discount_percent > 0 THEN discount_percent END), 1) AS avg_discount FROM records")
def discounts_and_stock(spark, sf):
    return pages.discounts(_records(spark, sf))


# The table of pages, by selectors

_DECODED = lambda c: f"replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


@query(f"WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1) AS items FROM pages), u AS (SELECT page_id, unnest(items) AS x, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS i FROM n) SELECT page_id, i, {_DECODED(chr(120))} AS label, {_DECODED(chr(114) + chr(101) + 'gexp_extract(x, ' + quoted('href=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34)) + ', 1)')} AS href FROM u")
def page_navigation(spark, sf):
    """The links of each page's navigation."""
    return select_items(table(spark, sf, "pages"), "page_id", ["nav ul > li"], {"label": "a[href]", "href": "a[href]@href"})


@query(f"SELECT page_id, trim({_DECODED('regexp_extract(html, ' + quoted('(?s)<article><h1>(.*?)</h1>') + ', 1)')}) AS heading, coalesce(trim({_DECODED('regexp_extract(html, ' + quoted('(?s)<footer>(.*?)</footer>') + ', 1)')}), '') AS footer, regexp_extract(html, '<html lang=.([a-z]+)', 1) AS lang FROM pages")
def page_articles(spark, sf):
    """Heading, footer and language of each page."""
    return select_items(table(spark, sf, "pages"), "page_id", ["html"], {"heading": "article > h1", "footer": "footer", "lang": "@lang"}).drop("i")


@query(f"SELECT page_id, CASE WHEN {' OR '.join(f'contains(lower(html), {quoted(w)})' for w in fixed.BLOCK_INDICATORS)} THEN 'blocked' WHEN " + " OR ".join(f"contains(html, {quoted(w)})" for w in fixed.NOT_FOUND) + " THEN 'missing' ELSE 'read' END AS status FROM pages")
def page_status(spark, sf):
    return pages.page_status(table(spark, sf, "pages"))


_SHOP_CATEGORIES = [(c.lower(), f"https://shop.example/c/{i}") for i, c in enumerate(fixed.CATEGORIES)]


@query("WITH c(key, url) AS (VALUES " + ", ".join(f"({quoted(k)}, {quoted(u)})" for k, u in _SHOP_CATEGORIES) + "), a AS (SELECT p_partkey, ['laptop', 'monitor', 'mouse', 'sofa'][p_partkey % 4 + 1] AS key FROM part) SELECT p_partkey, key, url FROM a JOIN c USING (key)")
def category_urls(spark, sf):
    key = F.element_at(F.array(*[F.lit(k) for k in ("laptop", "monitor", "mouse", "sofa")]), (F.col("p_partkey") % 4).cast("int") + 1)
    return pages.category_urls(table(spark, sf, "part").select("p_partkey", key.alias("key")), spark.createDataFrame(_SHOP_CATEGORIES, "key string, url string")).select("p_partkey", "key", "url")


@query("SELECT p_partkey, 'https://s/a/page' || p_partkey || '/' AS by_path, '?id=c' || p_size || '&p=' || p_partkey AS by_id, 'x?s=1&page=' || p_partkey AS by_query FROM part")
def page_urls(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", pages.page_url(F.lit("https://s/a/"), p, "path").alias("by_path"), pages.page_url(F.concat(F.lit("c"), F.col("p_size").cast("string")), p, "id").alias("by_id"), pages.page_url(F.lit("x?s=1"), p, "query").alias("by_query"))


@query("WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages) SELECT page_id, CASE WHEN ends_with(host, '.com') THEN CASE WHEN starts_with(path, '/en/6') THEN true WHEN starts_with(path, '/en/') THEN false WHEN starts_with(path, '/fr/') THEN false ELSE true END ELSE true END AS allowed FROM u")
def robots_allowed(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", "url")
    hosts = urls.select(F.parse_url("url", F.lit("HOST")).alias("host")).distinct().where(F.endswith("host", F.lit(".com")))
    rules = spark.createDataFrame([(0, "/en/6", True), (1, "/en/", False), (2, "/fr/", False)], "place int, path string, allow boolean")
    return pages.allowed(urls, hosts.crossJoin(F.broadcast(rules))).select("page_id", "allowed")


_W = "CAST(floor(p_retailprice) AS BIGINT)"


@query(f"SELECT p_partkey, {_W} + 0.5::DOUBLE AS eu, {_W} + 0.25::DOUBLE AS us, {_W} + 0.75::DOUBLE AS plain, CAST(NULL AS DOUBLE) AS none, CAST({_W} * 1000 AS DOUBLE) AS from_attribute, {_W} + 0.95::DOUBLE AS from_text, CAST({_W} AS DOUBLE) AS last_mark FROM part")
def price_text_forms(spark, sf):
    w = F.floor("p_retailprice")
    s = w.cast("string")
    k = F.concat(F.floor(w / 100).cast("string"), F.lit("."), F.lpad((w % 100).cast("string"), 2, "0"))
    return table(spark, sf, "part").select(
        "p_partkey",
        prices.text_price(F.concat(F.lit("prix "), F.replace(k, F.lit("."), F.lit("")), F.lit(",50 TND"))).alias("eu"),
        prices.text_price(F.concat(F.floor(w / 100).cast("string"), F.lit(","), F.lpad((w % 100).cast("string"), 2, "0"), F.lit(".25"))).alias("us"),
        prices.scraped_price(F.concat(s, F.lit(".75 DT"))).alias("plain"),
        prices.text_price(F.lit("sur demande")).alias("none"),
        prices.decimal_comma_price(F.concat(s, F.lit("000")), F.lit("1,00 €")).alias("from_attribute"),
        prices.decimal_comma_price(F.lit("n/a"), F.concat(s, F.lit(",95 €"))).alias("from_text"),
        prices.scraped_price(F.concat(k, F.lit(",00"))).alias("last_mark"),
    )


@query(f"WITH t AS (SELECT p_partkey, ['HP', 'msi', 'Razer', 'Other', 'HPX'][p_partkey % 5 + 1] || ' ' || p_name AS title, '/list?x=1&id=' || p_partkey AS href, CASE WHEN p_partkey % 2 = 0 THEN '/p/1' ELSE 'http://a/p/1' END AS url FROM part) SELECT p_partkey, upper({_FIRST('title', [fixed.SHOP_BRAND], 1)}) AS brand, CAST(p_partkey AS VARCHAR) AS listing, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://b' || url END AS url FROM t")
def shop_brand_and_links(spark, sf):
    n = F.col("p_partkey")
    title = F.concat_ws(" ", F.element_at(F.array(*[F.lit(b) for b in ("HP", "msi", "Razer", "Other", "HPX")]), (n % 5).cast("int") + 1), "p_name")
    href = F.concat(F.lit("/list?x=1&id="), n.cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.shop_brand(title).alias("brand"), text.pagination_id(href).alias("listing"), text.absolute_url(F.when(n % 2 == 0, "/p/1").otherwise("http://a/p/1"), "https://b").alias("url"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS amount, ['TND', 'EUR', 'USD', 'GBP'][l_linenumber % 4 + 1] AS currency FROM lineitem) SELECT currency, count(*) AS n, round(sum(amount * CASE currency WHEN 'EUR' THEN 1.0 WHEN 'TND' THEN 0.304 WHEN 'USD' THEN 1 / 1.25::DOUBLE ELSE 1.0 END), 0) AS eur FROM a GROUP BY 1")
def rate_priority(spark, sf):
    currency = F.element_at(F.array(*[F.lit(c) for c in ("TND", "EUR", "USD", "GBP")]), (F.col("l_linenumber") % 4).cast("int") + 1)
    rates = spark.createDataFrame([("TND", "EUR", 0.304), ("EUR", "TND", 3.29), ("EUR", "USD", 1.25)], "source string, target string, rate double")
    rows = prices.lookup_rates(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("amount"), currency.alias("currency")), rates, "EUR")
    return rows.groupBy("currency").agg(F.count("*").alias("n"), F.round(F.sum("converted"), 0).alias("eur"))


_L = {k: _FIRST("title", ps, 1) for k, ps in fixed.LISTED_PATTERNS.items()}
_LISTED = ["PC Intel Core i5-1135G7 8 Go RAM 512 Go SSD 15.6\"", "Core i7 10700 1 To", "GeForce now 16 Go", "i3-1005G1 Radeon Vega", "RTX 3060 clavier"]
_LISTED_SQL = f"[{', '.join(map(quoted, _LISTED))}][p_partkey % {len(_LISTED)} + 1]"


@query(f"WITH t AS (SELECT p_partkey, p_name || ' ' || {_LISTED_SQL} AS title FROM part) SELECT p_partkey, {_L['processor']} AS processor, {_L['gpu']} AS gpu, coalesce(CAST({_L['ram_gb']} AS INTEGER), -1) AS ram_gb, {_L['storage']} || ' ' || {_FIRST('title', fixed.LISTED_PATTERNS['storage'], 2)} || ' SSD' AS storage, {_L['screen_size']} || '\"' AS screen_size FROM t")
def title_specs_listed(spark, sf):
    title = F.concat("p_name", F.lit(" "), F.element_at(F.array(*[F.lit(t) for t in _LISTED]), (F.col("p_partkey") % len(_LISTED)).cast("int") + 1))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in text.title_specs(title, "listed").items()]).fillna(-1, ["ram_gb"])


# Exports


@query("SELECT 'categories' AS collection, 8 AS n UNION ALL SELECT 'users', 2 UNION ALL SELECT 'user_profiles', 2 UNION ALL SELECT 'stores', 3 UNION ALL SELECT 'search_history', 2 UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'reviews', count(*) FROM documents UNION ALL SELECT 'price_history', least(50, count(*)) * 5 FROM part")
def collection_counts(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    frames = {"categories": export.categories(spark, fixed.CATEGORIES)} | {c: export.sample_collection(spark, c) for c in ("users", "user_profiles", "stores", "search_history")}
    return export.collection_counts(frames | {"products": parts, "reviews": table(spark, sf, "documents"), "price_history": export.price_history(parts, "p_partkey", "v")})


@query("WITH r AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 500 AS part, p_partkey, p_name, p_size FROM part) SELECT part, md5('[' || string_agg('{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}', ',' ORDER BY p_partkey) || ']') AS digest FROM r GROUP BY 1")
def json_arrays(spark, sf):
    rows = files.as_json_arrays(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", 500)
    return rows.select("part", F.md5(F.col("array").cast("binary")).alias("digest"))


@query("SELECT p_partkey, format('prod_{:06d}', row_number() OVER (ORDER BY p_partkey)) AS one_based, format('prod_{:06d}', row_number() OVER (ORDER BY p_partkey) - 1) AS zero_based FROM part")
def generic_ids(spark, sf):
    return export.object_ids(table(spark, sf, "part").select("p_partkey"), "p_partkey", "prod")


@query("WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{\"ram\":\"8GB\",\"storage\":\"1 TB\"}' WHEN 1 THEN 'not json' END AS j FROM part) SELECT p_partkey, coalesce(CASE WHEN json_valid(j) THEN json_extract_string(j, '$.ram') END, 'none') AS ram, CASE WHEN j LIKE '{%' THEN 2 ELSE 0 END AS n FROM s")
def specs_from_json(spark, sf):
    said = F.when(F.col("p_partkey") % 3 == 0, '{"ram":"8GB","storage":"1 TB"}').when(F.col("p_partkey") % 3 == 1, "not json")
    specs = export.parse_specs(said)
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.try_element_at(specs, F.lit("ram")), F.lit("none")).alias("ram"), F.size(specs).alias("n"))


# Registry: every customer is a model, every order a version


@query(f"WITH {VERSIONS_SQL}, n AS (SELECT c_custkey AS name, coalesce((SELECT max(version) FROM versions v WHERE v.name = c_custkey), 0) + 1 AS version FROM customer) SELECT name, version, stage FROM versions UNION ALL SELECT name, CAST(version AS INTEGER), 'None' FROM n")
def registry_register(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.lit("2024-06-01").cast("timestamp").alias("created_at"))
    return lifecycle.register(versions(spark, sf), new).select("name", "version", "stage")


@query(f"WITH {VERSIONS_SQL}, n AS (SELECT c_custkey AS name, coalesce((SELECT max(version) FROM versions v WHERE v.name = c_custkey), 0) + 1 AS version FROM customer) SELECT name, version, stage FROM versions UNION ALL SELECT name, CAST(version AS INTEGER), 'Staging' FROM n")
def registry_backfill(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.lit("2024-06-01").cast("timestamp").alias("created_at"))
    return lifecycle.backfill(versions(spark, sf), new).select("name", "version", "stage")


@query(f"WITH {VERSIONS_SQL}, m AS (SELECT name, max(version) AS v, name % 2 = 0 AS a FROM versions GROUP BY 1) SELECT name, version, CASE WHEN version = v THEN 'Production' WHEN a AND stage = 'Production' THEN 'Archived' ELSE stage END AS stage FROM versions JOIN m USING (name)")
def registry_transition(spark, sf):
    rows = versions(spark, sf)
    moves = rows.groupBy("name").agg(F.max("version").alias("version")).select("name", "version", F.lit("Production").alias("stage"), (F.col("name") % 2 == 0).alias("archive_existing"))
    return lifecycle.transitions(rows, moves).select("name", "version", "stage")


@query(f"WITH {VERSIONS_SQL} SELECT name, max(version) AS latest_version, max(CASE WHEN stage = 'Production' THEN version END) AS production_version, max(CASE WHEN stage = 'Staging' THEN version END) AS staging_version FROM versions GROUP BY 1")
def registry_models(spark, sf):
    return lifecycle.models(versions(spark, sf))


@query(f"WITH {VERSIONS_SQL}, m AS (SELECT name, max(version) AS last, max(CASE WHEN stage = 'Production' THEN version END) AS p FROM versions GROUP BY 1), w AS (SELECT name, CASE WHEN name % 2 = 0 THEN 1 ELSE last END AS version FROM m) SELECT name, version, stage, created_at FROM versions JOIN w USING (name, version)")
def registry_details(spark, sf):
    rows = versions(spark, sf)
    wanted = rows.select("name").distinct().select("name", F.when(F.col("name") % 2 == 0, 1).alias("version"))
    return lifecycle.details(rows, wanted).select("name", "version", "stage", "created_at")


@query(f"WITH {VERSIONS_SQL}, m AS (SELECT name, max(CASE WHEN stage = 'Production' THEN version END) AS p FROM versions GROUP BY 1) SELECT name, CASE WHEN p IS NULL THEN 'local' ELSE CAST(p AS VARCHAR) END AS version, CASE WHEN p IS NULL THEN 'None' ELSE 'Production' END AS stage FROM m")
def registry_info(spark, sf):
    return lifecycle.info(versions(spark, sf))


@query(f"WITH {VERSIONS_SQL}, m AS (SELECT DISTINCT name FROM versions) SELECT CASE WHEN name % 2 = 0 THEN 'models:/' || name || '/2' ELSE 'models:/' || name END AS model_uri, CAST(name AS VARCHAR) AS model_name, CASE WHEN name % 2 = 0 THEN '2' ELSE 'production' END AS version, 'mlflow' AS framework, {quoted(lifecycle.INPUT_SCHEMA)} AS input_schema, {quoted(lifecycle.OUTPUT_SCHEMA)} AS output_schema FROM m")
def registry_serving_config(spark, sf):
    names = versions(spark, sf).select("name").distinct()
    return lifecycle.serving_config(names.select("name", F.when(F.col("name") % 2 == 0, 2).alias("version")))


_LOG_SQL = "l AS (SELECT user_id AS run_id, event_type AS key, value, event_id AS step FROM events UNION ALL SELECT DISTINCT user_id, 'done', 1.0::DOUBLE, 0 FROM events)"


@query(f"WITH {_LOG_SQL} SELECT run_id, key, arg_max(value, (step, value)) AS value, max(step) AS step FROM l GROUP BY 1, 2")
def metric_log(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("step"))
    done = log.select("run_id").distinct().select("run_id", F.lit("done").alias("key"), F.lit(1.0).alias("value"), F.lit(0).cast("long").alias("step"))
    return lifecycle.last_metrics(lifecycle.log_metrics(log, done))


@query("SELECT event_id AS run_id, event_type AS run_name FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 1")
def run_by_tag(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("start_time"), F.create_map(F.lit("runName"), F.col("event_type")).alias("tags"))
    return lifecycle.run_by_tag(runs, "runName", "click").select("run_id", F.element_at("tags", "runName").alias("run_name"))


# Alerts


@query(f"WITH {RUNS_SQL} SELECT 'volume' AS name, CAST(count(*) AS DOUBLE) AS value, 300.0::DOUBLE AS low, 500.0::DOUBLE AS high, count(*) BETWEEN 300 AND 500 AS ok FROM runs")
def volume_check(spark, sf):
    return monitoring.volume(run_rows(spark, sf))


@query("WITH d AS (SELECT event_type, user_id % 7 AS k, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'INVALID' ELSE 'ok' END AS remark FROM events), n AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS kinds FROM d) SELECT round(1 - (3 * count(*) - count(event_type) - count(k) - count(remark)) / (3.0 * count(*)), 6) AS completeness, round(1 - count(CASE WHEN lower(remark) = 'invalid' THEN 1 END) / (3.0 * count(*)), 6) AS validity, round(1 - (any_value(n) - any_value(kinds)) / CAST(any_value(n) AS DOUBLE), 6) AS consistency FROM d, n")
def row_quality(spark, sf):
    remark = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, "INVALID").otherwise("ok")
    return monitoring.row_quality(table(spark, sf, "events").select("event_type", (F.col("user_id") % 7).alias("k"), remark.alias("remark")))


@query(f"WITH {RUNS_SQL}, f AS (SELECT end_time FROM runs WHERE state = 'failed'), w AS (SELECT time_bucket(INTERVAL 5 MINUTES, end_time) - to_minutes(5 * k) AS window_start FROM f, range(12) t(k)) SELECT window_start, window_start + INTERVAL 60 MINUTES AS window_end, count(*) AS failures FROM w GROUP BY 1 HAVING count(*) > 3")
def failure_storm_sliding(spark, sf):
    return monitoring.sliding_storms(run_rows(spark, sf))


@query("SELECT round(epoch(TIMESTAMP '2024-03-01' - max(ts)) / 3600, 4) AS age_hours, round(1 - count(DISTINCT user_id) / CAST(count(*) AS DOUBLE), 6) AS duplicate_rate, count(CASE WHEN NOT coalesce(value > 50, false) THEN 1 END) AS invalid, round(epoch(TIMESTAMP '2024-03-01' - max(ts)) / 3600, 4) > 24 AS stale, round(1 - count(DISTINCT user_id) / CAST(count(*) AS DOUBLE), 6) > 0.05 AS duplicated, count(CASE WHEN NOT coalesce(value > 50, false) THEN 1 END) > 100 AS too_invalid FROM events")
def freshness(spark, sf):
    return monitoring.freshness(table(spark, sf, "events"), "ts", "user_id", F.col("value") > 50, "2024-03-01")


@query("SELECT event_id AS run_id, round(CAST(value * 1000 AS BIGINT) / 1000.0, 3) AS seconds, round(CAST(value * 1000 AS BIGINT) / 1000.0, 3) > 60 AS slow FROM events")
def run_durations(spark, sf):
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000).cast("long") * 1000)
    return monitoring.run_durations(table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("start_time"), end.alias("end_time")), 60.0).select("run_id", "seconds", "slow")


@query("SELECT event_type, count(*) AS total, count(CASE WHEN event_id % 19 <> 0 THEN 1 END) AS success, count(CASE WHEN event_id % 19 = 0 THEN 1 END) AS failed, round(count(CASE WHEN event_id % 19 <> 0 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS success_rate, round(sum(value) / count(CASE WHEN event_id % 19 <> 0 THEN 1 END), 4) AS seconds_per_item, count(CASE WHEN event_id % 19 <> 0 THEN 1 END) / CAST(count(*) AS DOUBLE) < 0.95 AS alert FROM events GROUP BY 1")
def scraping_performance(spark, sf):
    """Success and time for each item of scrapes; one item in 19 fails."""
    items = table(spark, sf, "events").select("event_type", (F.col("event_id") % 19 != 0).alias("ok"), F.col("value").alias("seconds"))
    return monitoring.scraping_performance(items, "event_type")


@query("SELECT column_name, missing, pct FROM (SELECT 'page_id' AS column_name, count(*) - count(page_id) AS missing, round((count(*) - count(page_id)) * 100.0 / count(*), 4) AS pct FROM pages UNION ALL SELECT 'odd', count(*) - count(CASE WHEN page_id % 7 <> 0 THEN 1 END), round((count(*) - count(CASE WHEN page_id % 7 <> 0 THEN 1 END)) * 100.0 / count(*), 4) FROM pages) WHERE missing > 0")
def missing_only(spark, sf):
    return stats.missing_only(table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 7 != 0, 1).alias("odd")))


@query("WITH p AS (SELECT d.doc_id, b.item_id, list_distinct(list_filter(string_split(lower(d.text), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(lower(b.text), ' '), lambda x: x <> '')) AS y FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents) d, (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM benchmark) b), s AS (SELECT doc_id, item_id, len(list_intersect(x, y)) AS c, len(x) AS a, len(y) AS b FROM p) SELECT doc_id, item_id, round(c / CAST(a + b - c AS DOUBLE), 6) AS similarity FROM s WHERE c > 0 AND c / CAST(a + b - c AS DOUBLE) >= 0.2")
def benchmark_token_jaccard(spark, sf):
    return stats.token_overlaps(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"), "doc_id", "item_id", 0.2)
