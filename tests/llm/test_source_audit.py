import random
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import source_audit
from tests.llm.helpers import DOCS, documents, empty, pairs

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def expected(rows):
    """From (text, lang, source), in plain loops over all terms."""
    rows = [(terms(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for t, x, source in rows:
            if x == lang:
                docs.update(set(t))
                counts[source].update(t)
        kept = sorted(t for t, n in docs.items() if n >= 3)
        whole = Counter()
        for x, source in {(x, s) for _, x, s in rows}:
            if x == lang:
                whole.update({t: counts[source][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        sources = {s for _, x, s in rows if x == lang}
        p = {s: shares(counts[s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources - {s}]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, 200)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items)]
    return sorted(out, key=str)


def corpus(seed, n=240):
    rng = random.Random(seed)
    names = [f"{a}{b}" for a in ("Wort", "é", "x-", "the", "Ünd", "字", "ab1") for b in "abcdefghijklmnopqrstuvwxyz"]
    return [(" ".join(rng.choice(names[: rng.choice([9, 60, 182])]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s0"] * 6 + ["s1", "s2", "s3", "", None])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None) for i, (t, lang, source) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("bits", [64, 6])
def test_equals_plain_loops(spark, bits):
    """With 6 bits nearly every digest is shared, so terms are split by their strings."""
    rows = corpus(bits)
    got = pairs(source_audit.audit(frame(spark, rows), bits=bits), *COLUMNS)
    assert got == expected(rows)
    assert {r[2] for r in got} == {"pair", "term"}


def test_terms_rank_to_200_with_ties(spark):
    names = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    rows = [(" ".join(names + names[:300] * (s == "a")), "en", s) for s in ("a", "a", "b")] + [("one more", "en", "c"), ("", "fr", "x"), (None, "fr", "y"), ("A a A", "it", "z")]
    got = pairs(source_audit.audit(frame(spark, rows)), *COLUMNS)
    assert got == expected(rows)
    assert max(r[5] for r in got if r[2] == "term") == 200
    assert [r for r in got if r[0] == "fr"] == [("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)]


def test_batches_that_end_inside_a_term(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((lang, d, f"s{k}") for lang in ("de", "en") for d in range(-3, 60) for k in rng.sample(range(12), rng.randrange(1, 12)))
    columns = [pa.array(c) for c in zip(*((lang, s, d, "", rng.randrange(10, 10**6), 10 + int(s[1:])) for lang, d, s in rows), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "digest", "split", "p", "base"])

    def sums(step, held):
        monkeypatch.setattr(source_audit, "HELD", held)
        out = Counter()
        for b in source_audit._overlaps(batch.slice(i, step) for i in range(0, batch.num_rows, step)):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["item"]] += r["value"]
        return out

    assert sums(7, 20) == sums(1000, 10**6) and len(sums(1000, 10**6)) == 2 * 12 * 11


def test_odd_rows_extra_columns_and_empty_table(spark):
    docs = documents(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert pairs(source_audit.audit(docs), *COLUMNS) == expected(rows)
    extra = documents(spark, extra=True).selectExpr("*", "'own' AS digest", "'own' AS count", "'own' AS item", "'own' AS terms")
    assert pairs(source_audit.audit(extra), *COLUMNS) == expected(rows)
    assert source_audit.audit(empty(spark)).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    big = 2**62 + 12345
    row = spark.range(1).select(source_audit._probability(F.lit(big), F.lit(2**62 + 10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (2**62 + 10**9)


def test_counts_are_shuffled_once_and_strings_sorted_when_distinct(spark):
    """The rows of tasks go to their term without another aggregation before, and the kept ones are found there."""
    texts = frame(spark, corpus(1)).select("text", "lang", "source")

    def steps(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return [x for x in re.findall(r"\b(MapInArrow|Exchange|HashAggregate|SortAggregate|Window)\b", plan)][::-1]

    counted, spelled = steps(source_audit._counted(texts, 64)), steps(source_audit._spelled(texts, 64))
    assert counted[:2] == spelled[:2] == ["MapInArrow", "Exchange"] and counted.count("Exchange") == spelled.count("Exchange") == 1
    assert "Window" in counted and spelled.index("HashAggregate") < spelled.index("SortAggregate")


@pytest.mark.parametrize("count", [0, 1, 8_999_999_999, 9_000_000_000, 9_000_000_001, 2**60])
def test_shares_of_short_and_long_counts(spark, count):
    from pyspark.sql import functions as F

    for total in (1, 7, count + 10**6):
        if (1 + 10**9 * (count + 1) // total) < 2**63:
            assert spark.range(1).select(source_audit._probability(F.lit(count), F.lit(total)).alias("p")).first().p == 1 + 10**9 * (count + 1) // total
