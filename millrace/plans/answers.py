"""Model answers made ready to show, and what is said when one fails."""

from pyspark.sql import functions as F

from millrace.functions import markdown, text
from millrace.plans.registry import query
from millrace.session import spread, table


def _answer():
    """A made-up answer: headings, bullets, quotes and plain lines, more of each than are kept."""
    k = F.col("p_partkey").cast("string")
    return F.concat(F.lit("# One  head\n\n\n\n> quoted   "), F.col("p_name"), F.lit("\n## Two\n#### Three\n* a\n- b\n1. c\n2. d\n+ e\n- f "), k, F.lit("\n\t plain line \n```x\ny```\n<b>"), F.col("p_type"), F.lit("</b>\n| t | u |"))


@query("""
SELECT p_partkey, '### One head' || chr(10) || chr(10) || 'quoted ' || p_name || chr(10) || '### Two' || chr(10) || 'Three' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || '- c' || chr(10) || '- d' || chr(10) || '- e' || chr(10) || 'f ' || p_partkey || chr(10) || 'plain line' || chr(10) || chr(10) || p_type AS reason,
  '### One head' || chr(10) || chr(10) || 'quoted ' || p_name || chr(10) || '### Two' || chr(10) || 'Three' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || '- c' || chr(10) || '- d' || chr(10) || '- e' || chr(10) || 'f ' || p_partkey || chr(10) || 'plain line' || chr(10) || chr(10) || p_type AS chat FROM part""")
def markdown_answers(spark, sf_dir):
    """Answers as light markdown: two headings, five bullets, no fences, tags and tables."""
    cut = F.regexp_replace(_answer(), r"\n\| t \| u \|$", "")
    return spread(table(spark, sf_dir, "part")).select("p_partkey", markdown.reason(cut).alias("reason"), markdown.chat(_answer()).alias("chat"))


@query(r"""
WITH s AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents),
n AS (SELECT doc_id, t, CAST(floor(length(t) / 2) AS BIGINT) AS m FROM s),
w AS (SELECT *, substr(t, greatest(m - 60, 0) + 1, least(m + 60, length(t)) - greatest(m - 60, 0)) AS part FROM n),
c AS (SELECT *, CASE WHEN contains(part, ' ') THEN greatest(m - 60, 0) + length(part) - strpos(reverse(part), ' ') END AS cut_at FROM w)
SELECT doc_id, CASE WHEN length(t) > 220 AND cut_at > 0 AND trim(substr(t, 1, cut_at)) <> '' AND trim(substr(t, cut_at + 2)) <> '' THEN trim(substr(t, 1, cut_at)) || chr(10) || chr(10) || trim(substr(t, cut_at + 2)) ELSE t END AS parted,
  CASE WHEN length(t) > 220 AND cut_at > 0 THEN 2 ELSE 1 END AS paragraphs FROM c""")
def long_text_parts(spark, sf_dir):
    """Long texts cut to two paragraphs near their middle."""
    t = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    parted = text.split_long(t)
    return table(spark, sf_dir, "documents").select("doc_id", parted.alias("parted"), F.size(F.split(parted, "\n\n")).alias("paragraphs"))


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])[\s]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), '\n')) AS s, generate_subscripts(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])[\s]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), '\n'), 1) AS i FROM conversations),
k AS (SELECT conv_id, turn, i, trim(regexp_replace(s, '[\s\p{Z}]+', ' ', 'g')) AS s FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS n FROM k WHERE s <> ''),
p AS (SELECT conv_id, turn, n // 2 AS p, string_agg(s, ' ' ORDER BY n) AS s FROM n GROUP BY ALL)
SELECT conv_id, turn, string_agg(s, chr(10) || chr(10) ORDER BY p) AS shown FROM p GROUP BY ALL""")
def sentence_paragraphs(spark, sf_dir):
    """Turns as paragraphs of two sentences."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.paragraphs(F.col("text")).alias("shown")).where("shown <> ''")


def _merged(k):
    """Explanations that fail in each way, and one that does not."""
    good = "데이터셋은 이렇게 고릅니다 하나. Open API 는 저렇게 고릅니다 둘. 그래서 이 자료가 좋습니다 셋. 마지막으로 확인이 필요합니다 넷."
    texts = ("", "```x```", "<p>가나다라마바</p>", "짧은 글입니다 하나.", "하나의 문장입니다 가. " * 13, "This answer is all English now. It goes on and on here. There are four sentences. The last one ends it.", good.replace("데이터셋", "이것"), good.replace("Open API", "저것"), good)
    out = F.lit(texts[-1])
    for i, t in enumerate(texts[:-1]):
        out = F.when(k % 9 == i, t).otherwise(out)
    return out


_CODES = ("empty", "markdown_code_block", "html_tag", "too_short", "too_long", "low_korean_ratio", "missing_dataset_perspective", "missing_openapi_perspective")


@query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END AS code FROM part")
def merged_text_codes(spark, sf_dir):
    """Why a merged explanation is refused, or null."""
    raw = _merged(F.col("p_partkey"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", text.merged_text_code(raw, raw).alias("code"))


@query("""
SELECT p_partkey, '요청하신 ''' || p_name || ''' 목적을 기준으로 데이터셋과 Open API 추천 근거를 함께 검토했습니다.' || chr(10) || chr(10) || '데이터셋 측면에서는 ' || p_type || ' fits the request 또한 second reason of it.' || chr(10) || chr(10)
  || 'Open API 측면에서는 Open API 후보의 제공 범위와 인증 방식을 중심으로 정리했습니다 또한 실제 연계 시 필요한 제약 조건을 함께 검토했습니다.' || chr(10) || chr(10) || '근거가 제한된 항목은 확인 필요로 보고, 실제 적용 전 최신 문서와 접근 권한을 점검하는 것을 권장합니다.' AS shown,
  p_type || ' fits the request|second reason of it.' AS points, '[1] name - ' || p_type || ' fits the request' || ' ' || '* second reason of it.' AS context, '[1] name - ' || p_type || ' fits the request' AS card FROM part""")
def fallback_explanations(spark, sf_dir):
    """The explanation in place of a model's, and what of a reason goes to the next model and to a card."""
    lines = F.concat(F.lit("[1] name - "), F.col("p_type"), F.lit(" fits the request\n\n* second reason of it.\nshort\n"))
    other = F.when(F.col("p_partkey") >= 0, F.lit("tiny"))
    context = markdown.reason_context(F.regexp_replace(lines, r"short\n", ""))
    card = markdown.card_reason(F.concat(F.lit("요약 추천: x\r\n\r\n"), lines))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", markdown.fallback_explanation(F.col("p_name"), lines, other).alias("shown"), F.array_join(markdown.reason_points(lines), "|").alias("points"), context.alias("context"), card.alias("card"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'dataset=timeout of ' || o_orderkey WHEN 1 THEN 'dataset=timeout of ' || o_orderkey || ' | openapi=quota' WHEN 2 THEN 'openapi=quota' ELSE '추천 생성 중 오류가 발생했습니다.' END AS summary,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Bearer *** refused by host' ELSE 'api_key=*** refused by host' END AS error, 500 AS cut_length FROM orders""")
def failure_texts(spark, sf_dir):
    """Summaries of failed runs: both kinds, on one line, without secrets."""
    k = F.col("o_orderkey")
    dataset = F.when(k % 4 <= 1, F.concat(F.lit("timeout of\n "), k.cast("string"))).otherwise("  ")
    openapi = F.when((k % 4).isin(1, 2), "quota")
    error = F.when(k % 2 == 0, "Bearer abc.def  refused\nby host").otherwise("api_key=xyz refused by host")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.failure_summary(dataset, openapi).alias("summary"), text.error_text(error).alias("error"), F.char_length(text.cut(F.concat("o_orderpriority", F.lit("x" * 600)), 500)).alias("cut_length"))


@query("SELECT conv_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS title, length(substr(text, 1, 7)) AS n_cut FROM conversations WHERE turn = 0")
def conversation_titles(spark, sf_dir):
    """Titles of conversations from their first turn; hard cuts."""
    from millrace.operators import conversation

    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", conversation.title(F.col("text")).alias("title"), F.char_length(text.cut(F.col("text"), 7)).cast("bigint").alias("n_cut"))


_LABELS = ("Publisher", "Update Cycle", "All Rows", "데이터 포맷")


@query("SELECT p_partkey, p_brand AS publisher, 'Monthly' AS cycle, CAST(p_size AS VARCHAR) AS n_rows, CASE WHEN p_partkey % 2 = 0 THEN 'CSV' END AS format, true AS uuid_found FROM part")
def labelled_blocks(spark, sf_dir):
    """Values of labels in a page's flattened table; ids in texts."""
    block = F.concat(F.lit("Publisher "), F.col("p_brand"), F.lit(" Update Cycle: Monthly All Rows "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " 데이터 포맷 : CSV").otherwise(""))
    values = text.labelled_values(block, list(_LABELS))
    uuid = text.uuid_of(F.concat(F.lit("see 0a1b2c3d-0000-4000-8000-00000000000"), (F.col("p_partkey") % 10).cast("string"), F.lit(" there")))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", values["Publisher"].alias("publisher"), values["Update Cycle"].alias("cycle"), values["All Rows"].alias("n_rows"), F.try_element_at(values, F.lit("데이터 포맷")).alias("format"), uuid.isNotNull().alias("uuid_found"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'metro|weather' ELSE 'openapi|추천해줘' END AS dataset_terms, CASE WHEN p_partkey % 2 = 0 THEN 'metro|openapi|weather' ELSE 'openapi' END AS api_terms FROM part")
def request_terms(spark, sf_dir):
    """Words of a request that say something, for both catalogues; all words where none does."""
    request = F.when(F.col("p_partkey") % 2 == 0, "Metro weather openapi 추천해줘").otherwise("openapi 추천해줘")
    words = text.tokens(request)
    joined = lambda w: F.array_join(F.array_sort(w), "|")
    return table(spark, sf_dir, "part").select("p_partkey", joined(text.query_terms(words, text.DATASET_STOP, api_words=True)).alias("dataset_terms"), joined(text.query_terms(words, text.API_STOP)).alias("api_terms"))
