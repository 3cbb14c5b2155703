"""Functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, dates, nested, numbers, text
from millrace.operators import conversation, ingest, metrics, retrieval, tables


def value(spark, column, **literals):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in literals.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "column,x,want",
    [
        (lambda x: text.clean(x), " a &amp; <b>b</b>\n c ", "a & b c"),
        (lambda x: text.clean(x), "<p> </p>", None),
        (lambda x: text.clean(x), "&amp;lt;", "&lt;"),
        (lambda x: text.html_text(x), "<style>p{}</style>a<script>x</script>", "a"),
        (lambda x: text.lines(x), "a\r\n\n b ", ["a", "b"]),
        (lambda x: text.first_sentence(x), "One. Two.", "One."),
        (lambda x: text.first_sentence(x), "no end\nnext", "no end next"),
        (lambda x: text.clip(x, 10), " a  b\nc", "a  b c"),
        (lambda x: text.clip(x, 10), "abcdefghijkl", "abcdefg..."),
        (lambda x: text.tokens(x), "The the 한국 a, B2b!", ["the", "한국", "b2b"]),
        (lambda x: text.sanitize_identifiers(x), "- fits (id: 7) dataset_id=12 well;", "fits (id: 7) well"),
        (lambda x: text.strip_markdown(x), "# A\n- **b** [c](http://d) `e`", "A b c e"),
        (lambda x: text.sentences(x, 6), "One two. No! Three four five?", ["One two.", "Three four five?"]),
        (lambda x: text.paragraphs(x), "Aaaaaa. Bbbbbb. Cccccc.", "Aaaaaa. Bbbbbb.\n\nCccccc."),
        (lambda x: text.hangul_ratio(x), "한국ab", 0.5),
        (lambda x: text.merged_text_code(x, x), "short", "too_short"),
        (lambda x: text.uuid_of(x), "id 123E4567-e89b-12d3-a456-426614174000!", "123e4567-e89b-12d3-a456-426614174000"),
        (lambda x: text.hashtags(x), "#a b #한글 #a", ["a b", "한글", "a"]),
        (lambda x: text.split_keywords(x), "a; b,c", ["a", "b,c"]),
        (lambda x: text.split_keywords(x), "a / b", ["a", "b"]),
        (lambda x: text.url_authority(x), "https://User@H.example.com:8/p", "user@h.example.com:8"),
        (lambda x: text.url_authority(x), "ftp://x", None),
        (lambda x: text.slug(x), " Hello, World! ", "hello-world"),
        (lambda x: text.markdown_link(x)["url"], "see [n](http://u/x) ", "http://u/x"),
        (lambda x: text.version_suffix(x), "name_v1.2", "v1.2"),
        (lambda x: text.labelled_values(x, ["Title", "Publisher"]), "Title: a b Publisher: c", {"Title": "a b", "Publisher": "c"}),
        (lambda x: text.error_text(x), "api_key=abc failed", "api_key=*** failed"),
        (lambda x: numbers.parse_int(x), "about 1,234 rows", 1234),
        (lambda x: numbers.parse_float(x), "-2.50 GB", -2.5),
        (lambda x: numbers.parse_bool(x), " Yes ", True),
        (lambda x: numbers.parse_bool(x), "없음", False),
        (lambda x: numbers.parse_bool(x), "maybe", None),
        (lambda x: numbers.parse_bytes(x), "1.5 KiB", 1536),
        (lambda x: numbers.parse_bytes(x), "-1", -1),
        (lambda x: numbers.commercial_use(x), "CC-BY-NC 4.0", False),
        (lambda x: numbers.commercial_use(x), "MIT License", True),
        (lambda x: numbers.commercial_use(x), "custom", None),
        (lambda x: numbers.modalities(x), "images: an image and speech", ["image", "audio"]),
        (lambda x: dates.relative_hours(x), "30분 전", 0.5),
        (lambda x: dates.relative_hours(x), "2일 전", 48.0),
        (lambda x: dates.kst_converted(dates.parse_datetime(x)), "2026-03-24T15:30:00+00:00", "2026-03-25T00:30:00+09:00"),
        (lambda x: dates.kst_converted(dates.parse_datetime(x)), "2026-03-24T00:00:00", "2026-03-24T09:00:00+09:00"),
        (lambda x: nested.localized(x, "ko", "en"), '{"en": "b", "ko": " "}', "b"),
        (lambda x: nested.localized(x, "ko"), "plain", "plain"),
        (lambda x: nested.node_value(x), '{"@id": "http://x"}', "http://x"),
        (lambda x: nested.entries_to_map(x), '[{"key":"a","value":"1"},{"key":"a","value":"2"},{"key":"b","value":"3"}]', {"a": "2", "b": "3"}),
        (lambda x: nested.pruned(("secret",))(x), '{"b": {"c": ""}, "a": [" x ", null], "Secret": 1}', '{"a":["x"]}'),
        (lambda x: nested.first_object(x), 'Sure: {"a": {"b": "}"},} bye', '{"a": {"b": "}"}}'),
        (lambda x: ingest.bad_title(x), "123", True),
        (lambda x: ingest.bad_title(x), "Traffic counts of Seoul", False),
        (lambda x: ingest.bad_description(x), "http://a http://b", True),
        (lambda x: conversation.title(x, 5), "abcdefg", "abcde..."),
    ],
)
def test_text_functions(spark, column, x, want):
    assert value(spark, column(F.col("x")), x=x) == want


@pytest.mark.parametrize(
    "column,x,want",
    [
        (lambda x: arrays.unique_ci(x), ["A", " a", "", "b", "B "], ["A", "b"]),
        (lambda x: arrays.term_list(x, 2, 3), ["개인정보처리방침", "alpha", "beta", "gamma"], ["alp", "bet"]),
        (lambda x: arrays.positive_ids(x), [3, 3, 1], [3, 1]),
        (lambda x: arrays.positive_ids(x), [3, 0], None),
        (lambda x: arrays.chunked(x, 2), [1, 2, 3], [[1, 2], [3]]),
        (lambda x: text.prefixed(x, "language:"), ["language:ko", "x"], ["ko"]),
        (lambda x: text.query_terms(x, ("api",)), ["api", "weather"], ["weather"]),
        (lambda x: text.query_terms(x, ("api",)), ["api"], ["api"]),
        (lambda x: numbers.l2_normalized(x), [3.0, 4.0], [0.6, 0.8]),
        (lambda x: numbers.l2_normalized(x), [0.0, 0.0], [0.0, 0.0]),
    ],
)
def test_array_functions(spark, column, x, want):
    assert value(spark, column(F.col("x")), x=x) == want


def test_tri_state_access(spark):
    n = F.lit(None).cast("boolean")
    f, t, none = F.lit(False), F.lit(True), F.lit(None).cast("string")
    got = spark.range(1).select(
        numbers.access_type(none, t, t, f, f).alias("a"), numbers.access_type(none, f, f, f, f).alias("b"), numbers.access_type(none, n, f, f, f).alias("c"), numbers.access_type(F.lit("X"), t, f, f, f).alias("d"), numbers.access_type(none, n, n, t, n).alias("e")
    )
    assert tuple(got.first()) == ("PAID", "OPEN", "UNKNOWN", "PAID", "RESTRICTED")


def test_choice_of_fields(spark):
    df = spark.createDataFrame([("-", "b", " "), ("a", "b", None)], ["Data Name", "other", "ti_tle"])
    assert [r.v for r in df.select(ingest.choose(F.col("Data Name"), F.col("other")).alias("v")).collect()] == ["b", "a"]
    assert [r.v for r in df.select(ingest.pick(df, "Title", "data_name").alias("v")).collect()] == ["-", "a"]
    urls = spark.range(1).select(*(c.alias(n) for n, c in zip("cl", ingest.cross_filled(F.lit("bad"), F.lit("https://x/y")))))
    assert tuple(urls.first()) == ("https://x/y", "https://x/y")
    assert spark.range(1).select(ingest.title_or_null(F.lit("77"), F.lit("77")).alias("v")).first().v is None


def test_record_hash_ignores_empty_fields_and_order(spark):
    df = spark.range(1)
    a, b, c = (df.select(h.alias("v")).first().v for h in (ingest.record_hash(b=F.lit("1"), a=F.lit("x")), ingest.record_hash(a=F.lit("x"), b=F.lit("1"), z=F.lit("")), ingest.record_hash(a=F.lit("x"), b=F.lit("2"))))
    assert a == b != c


def test_embedder_is_deterministic_and_normal(spark):
    rows = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    first, second = ([r.embedding for r in ingest.embedded(rows, "t", ingest.hashing_embedder(8)).collect()] for _ in range(2))
    assert first == second and abs(sum(x * x for x in first[0]) - 1) < 1e-6 and first[1] == [0.0] * 8


def test_upsert_twice_is_the_same(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, limit int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 7)], "k int, name string, limit int")
    once = tables.upsert(old, new, ["k"], keep=("limit",))
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5), (2, None, 6), (3, "c", 7)] == sorted(map(tuple, tables.upsert(once, new, ["k"], keep=("limit",)).collect()))


@pytest.mark.parametrize("scratch,limited,failed,seen,want", [(True, False, 0, 1, True), (False, False, 0, 1, False), (True, True, 0, 1, False), (True, False, 1, 5, False), (True, False, 0, 0, False)])
def test_reconcile_guard(scratch, limited, failed, seen, want):
    assert tables.may_reconcile(scratch, limited, failed, seen) is want


def test_held_for(spark):
    rows = [("a", f"2026-01-01 00:0{m}:00", m in (1, 2, 3, 5)) for m in range(7)]
    df = spark.createDataFrame(rows, "k string, t string, down boolean").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.began.minute for r in metrics.held_for(df, "k", "t", F.col("down"), 120).collect()] == [1]


def test_retrieval_cuts_and_ranks(spark):
    df = spark.createDataFrame([(i, "weather of seoul", 0.9 - i / 10, 1.0, 1.0, i == 1, None, None) for i in range(6)], "resource_id int, content string, similarity double, coverage double, quality double, restricted boolean, approval boolean, payment boolean")
    rows = retrieval.ranked(retrieval.scored(df, "weather api", retrieval.DATASETS), n=3).collect()
    assert [(r.rank, r.resource_id) for r in rows] == [(1, 0), (2, 1), (3, 2)] and rows[0].score == 94.0 and rows[1].score == 84.5
