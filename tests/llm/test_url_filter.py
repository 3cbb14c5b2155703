import re

from pyspark.sql import functions as F

from millrace.llm import url_filter
from tests.llm.helpers import pairs

URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/q?x#y", "http://m.example.net/es/1", "http://net/fr/", "http://x.com", "http://x.com?y=/en/",
    "https://b.spam-farm.example.org/xx", "https://spam-farm.example.com/de/1", "https://spam-farm.example.com/en/1", "ftp://ünï.example.net/fr/é", "http://notexample.com/en/", "http://a..com/", "x://y://example.com/en/", "http://example.com/en", "http://example.com/en/" + "z" * 20000,
]


def want(url):
    m = re.match(r"[^/?#]*", rest := url.split("://", 1)[1]) if url and "://" in url else None
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]) if m else ""
    path = re.match(r"[^?#]*", rest[m.end() :])[0] if m else ""
    rule = max((h + p for (h, p), _ in url_filter.RULES if ("." + host).endswith("." + h) and host and path.startswith(p)), key=len, default=None)
    blocked = {h + p: b for (h, p), b in url_filter.RULES}
    block = blocked[rule] if rule else any(("." + host).endswith("." + h) for h in url_filter.BLOCKED_HOSTS)
    return host, path, rule, "block" if block else "allow"


def test_verdicts_match_brute_force(spark):
    rows = [(i if i else None, u, "own", "own") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = pairs(url_filter.verdicts(pages), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *want(u)) for i, u, *_ in rows), key=str)


def test_empty_table(spark):
    assert url_filter.verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where(F.xxhash64("key") % 37 == 0)
    cascade = url_filter.BloomCascade.build(listed.union(listed), universe)
    assert len(cascade.levels) >= 2
    wrong = universe.join(listed.withColumn("on", F.lit(True)), "key", "left").where(cascade.contains(F.col("key")) != F.coalesce("on", F.lit(False)))
    assert wrong.count() == 0
    # the list, not the universe, bounds the size
    assert sum(bits for bits, _, _ in cascade.levels) < 40 * listed.count()


def test_empty_list(spark):
    cascade = url_filter.BloomCascade.build(spark.createDataFrame([], "key string"), spark.range(3).select(F.col("id").cast("string").alias("key")))
    assert spark.range(3).where(cascade.contains(F.col("id").cast("string"))).count() == 0
