"""Rules of robots.txt against the standard library's answers, and rates as of a time against a plain look-up."""

from __future__ import annotations

import datetime as dt
import random
from urllib.robotparser import RobotFileParser

import pytest

from martlens.operators.rates import rates_as_of
from martlens.sources.robots import allowed_by_rules, parsed_rules

FILES = {
    "a.example": "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /q?x=1\nCrawl-delay: 5\n\nUser-agent: Good/1.0\nUser-agent: better\nDisallow:\n\nUser-agent: bad\nDisallow: /\n",
    "b.example": "Sitemap: x\nAllow: /lost\nUser-agent: bad\nDisallow: *\n# only for some\n",
    "c.example": "User-agent: *\nAllow: /caf%C3%A9/x\nDisallow: /café\nDisallow: /a%2fb\n Disallow : /spaced # remark\n",
    "d.example": "",
    "e.example": None,
}
PATHS = ["", "/", "/private", "/private/open/1", "/q?x=1&y", "/q?y=1", "/café/x", "/caf%C3%A9/y", "/a/b", "/a%2Fb", "/spaced", "/other#f", "/lost"]


@pytest.mark.parametrize("agent", ["*", "Good", "better/2", "bad", "nobody"])
def test_answers_are_those_of_the_standard_library(spark, agent):
    urls = [f"https://{h}{p}" for h in (*FILES, "none.example") for p in PATHS] + ["no url", None]
    want = {}
    for url in urls:
        parser = RobotFileParser()
        host = url.split("/")[2] if url and "//" in url else ""
        parser.parse((FILES.get(host) or "").splitlines())
        want[url] = True if url is None else parser.can_fetch(agent, url)
    files = spark.createDataFrame(list(FILES.items()), "host string, text string")
    got = allowed_by_rules(spark.createDataFrame([(u,) for u in urls], "url string"), parsed_rules(files, agent)).collect()
    assert {r["url"]: r["allowed"] for r in got} == want


def test_a_host_with_very_many_rules(spark):
    text = "User-agent: *\n" + "".join(f"{'Allow' if i % 3 else 'Disallow'}: /p{i}/\n" for i in range(100_000)) + "Disallow: /p\n"
    rules = parsed_rules(spark.createDataFrame([("h", text)], "host string, text string"))
    assert rules.count() == 100_001
    urls = spark.range(0, 200_000, 7).selectExpr("id", "concat('http://h/p', id, '/x') as url")
    got = allowed_by_rules(urls, rules)
    assert got.count() == urls.count()
    assert got.where("allowed <> (id < 100000 and id % 3 > 0)").count() == 0


@pytest.mark.parametrize("piece", [5, 3600])
def test_rates_as_of(spark, piece):
    rng, t0 = random.Random(piece), dt.datetime(2024, 1, 1)
    at = lambda: t0 + dt.timedelta(seconds=rng.randrange(400))
    quotes = [(rng.choice("xy"), at(), rng.randrange(100) / 10) for _ in range(40)] + [("x", None, 1.0), (None, t0, 1.0), ("y", t0, None)]
    amounts = [(i, rng.choice(["x", "y", "z", None]), None if i % 50 == 0 else at(), 7.0) for i in range(400)]
    got = rates_as_of(spark.createDataFrame(amounts, "id long, currency string, ts timestamp, rate double").repartition(3), spark.createDataFrame(quotes, "currency string, ts timestamp, rate double"), 30, piece)
    names = got.columns
    assert names == ["id", "currency", "ts", "rate", "rate", "quoted_at"]
    rows = {r[0]: (r[4], r[5]) for r in got.collect()}
    assert len(rows) == 400
    for i, currency, ts, _ in amounts:
        known = [(t, -r) for c, t, r in quotes if c == currency and None not in (c, t, r, ts) and t <= ts]
        best = max(known, default=None)
        want = (None, None) if best is None or (ts - best[0]).total_seconds() >= 30 else (-best[1], best[0])
        assert rows[i] == want, (i, currency, ts)
