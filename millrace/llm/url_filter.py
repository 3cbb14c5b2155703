"""URL filter: host and path rules, and a list of blocked hosts, looked up in Bloom filter cascades.

A cascade tells exactly which keys of a known universe are on a list. Level 1 is a Bloom filter of the listed keys; level 2 holds the
keys of the universe that level 1 takes for listed but are not; level 3 the listed keys that level 2 takes for those; and so on until
no key is mistaken. A key's answer is the parity of the first level that does not hold it. The universe is every key that any url of
the corpus can ask for, so every answer is exact, without a join.

Level 1 has a false-positive rate of about sqrt(1/2) * listed / universe and the later levels one half, so the second level has fewer
keys than the list (in expectation 0.7 of it) and all levels together take O(listed * log(universe / listed)) bits: a list of a million
hosts over a hundred million keys takes about 2 MB. That bound, not the corpus, sets the size of the plan, in which each level is one
binary value; ``MAX_BITS`` is checked. Everything is DataFrame functions; building and looking up use no join.

Null urls, and urls without ``://``: host and path empty, rule null, verdict allow (nothing is listed). Empty tables give no rows,
repeated rows one verdict each; extra columns are ignored.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: Fixed values: (host, path), and whether the rule blocks.
RULES = ((("com", "/"), False), (("example.com", "/en/"), True), (("www.example.com", "/en/"), False), (("net", "/es/"), True), (("net", "/fr/"), True))
#: The production list: hosts (with all their subdomains) of advertising, gambling and spam.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets") for top in ("com", "net", "org"))
MAX_BITS = 1 << 26
_HASHES = 8
#: Bytes of a level that come to the driver at once.
_PART = 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null or without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain, longest first; no entry for an empty host."""
    parts = F.split(host, r"\.", -1)
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(names)


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The path's starts of the given lengths (code points) that it is long enough for."""
    starts = F.array(*(F.when(F.char_length(path) >= n, F.left(path, F.lit(n))) for n in lengths))
    return F.filter(starts, lambda p: p.isNotNull())


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every ``host`` + ``path`` key that a rule with a path of one of these lengths could have and fit this url."""
    prefixes = path_prefixes(path, lengths)
    return F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


class BloomCascade:
    """Levels of (bits, hashes, bytes); ``contains`` is a column expression."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels

    @staticmethod
    def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits)) for i in range(hashes)]

    @classmethod
    def _in_level(cls, key: Column, at: int, level: tuple[int, int, bytes]) -> Column:
        bits, hashes, table = level
        table, out = F.lit(table), F.lit(True)  # one value, which all positions share
        for p in cls._positions(key, at, bits, hashes):
            byte = F.conv(F.hex(F.substring(table, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.bit_get(byte, (p % 8).cast("int")) == 1)
        return out

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for at in reversed(range(len(self.levels))):
            answer = F.when(self._in_level(key, at, self.levels[at]), answer).otherwise(F.lit(at % 2 == 1))
        return answer

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> "BloomCascade":
        """A cascade for ``listed.key`` over ``universe.key`` (repeats and nulls allowed; listed keys join the universe)."""
        listed = listed.where(F.col("key").isNotNull()).distinct()
        n = listed.count()
        if not n:
            return cls([])
        total = universe.select(F.approx_count_distinct("key").alias("n")).first().n
        levels: list[tuple[int, int, bytes]] = []
        inside, others, rate = listed, universe.where(F.col("key").isNotNull()), min(0.5, math.sqrt(0.5) * n / max(total, n))
        while n:
            hashes = max(1, min(_HASHES, round(-math.log2(rate))))
            bits = max(8, math.ceil(-hashes * n / math.log(1 - rate ** (1 / hashes)) / 8) * 8)
            if bits > MAX_BITS:
                raise ValueError(f"the list needs {bits} bits; MAX_BITS is {MAX_BITS}")
            at = len(levels)
            hits = inside.select(F.explode(F.array(*cls._positions(F.col("key"), at, bits, hashes))).alias("p")).select(F.floor(F.col("p") / 8).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int")).alias("b"))
            table = bytearray(bits // 8)
            made = hits.groupBy("w").agg(F.bit_or("b").alias("b")).coalesce(1 + len(table) // _PART)  # a job a partition
            for row in made.toLocalIterator():
                table[row.w] = row.b
            levels.append((bits, hashes, bytes(table)))
            mistaken = others.where(cls._in_level(F.col("key"), at, levels[-1])).select("key")
            if at == 0:  # of the universe, without the list
                marked = mistaken.withColumn("on", F.lit(False)).unionByName(listed.select("key").withColumn("on", F.lit(True)))
                mistaken = marked.groupBy("key").agg(F.bool_or("on").alias("on")).where("not on").select("key")
            mistaken = stored(mistaken.distinct(), "mistaken")
            n, rate = mistaken.count(), 0.5
            inside, others = mistaken, inside
        return cls(levels)


def verdicts(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed_host (the listed host that covers it, or null)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    names = [h + p for (h, p), _ in rules]
    lengths = sorted({len(p) for (_, p), _ in rules})
    keys = rule_keys(F.col("host"), F.col("path"), lengths)
    rule_cascade = BloomCascade.build(_column(spark, names), parsed.select(F.explode(keys).alias("key")))
    host_cascade = BloomCascade.build(_column(spark, list(blocked_hosts)), parsed.select(F.explode(host_suffixes(F.col("host"))).alias("key")))
    fits = F.filter(keys, rule_cascade.contains)
    listed = F.filter(host_suffixes(F.col("host")), host_cascade.contains)
    longest = F.reduce(fits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    out = parsed.withColumn("rule", longest).withColumn("listed_host", F.get(listed, F.lit(0)))
    blocks = [n for n, (_, b) in zip(names, rules, strict=True) if b]
    ruled = F.when(F.col("rule").isin(blocks), "block").otherwise("allow")
    by_list = F.when(F.col("listed_host").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), ruled).otherwise(by_list).alias("verdict"), "listed_host")


def _column(spark: SparkSession, keys: list[str]) -> DataFrame:
    if not keys:
        return spark.createDataFrame([], "key string")
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("key"))
