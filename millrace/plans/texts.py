"""Text, arrays, JSON and conversations."""

from pyspark.sql import functions as F

from millrace.functions import arrays, dates, nested, numbers, text
from millrace.operators import conversation, ingest, tables
from millrace.plans.registry import query
from millrace.plans.sql import any_of, clean
from millrace.session import table


@query("""
WITH t AS (SELECT *, least(length(text), 400) AS size FROM conversations),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT conv_id, turn, CAST(length(substr(substr(text, 1, 400), 1, CAST(greatest(0, 1500 - before) AS BIGINT))) AS INTEGER) AS n_given FROM b""")
def history_char_budget(spark, sf_dir):
    """How much of each turn fits a budget of characters, newest first."""
    rows = conversation.within_budget(table(spark, sf_dir, "conversations"), 1500, 400)
    return rows.select("conv_id", "turn", F.char_length("given").alias("n_given"))


@query(r"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, replace(regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(10), ' ') AS t FROM conversations)
SELECT conv_id, string_agg(upper(role) || ': ' || CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END, chr(10) ORDER BY turn) AS prompt FROM r WHERE n <= 3 GROUP BY conv_id""")
def last_n_turns(spark, sf_dir):
    """The last three turns as a prompt."""
    return conversation.last_turns(table(spark, sf_dir, "conversations"), 3, 60)


@query("SELECT conv_id, max(turn) AS last_turn, CASE WHEN max(turn) % 2 = 0 THEN max(turn) + 1 ELSE max(turn) + 2 END AS next_turn FROM conversations GROUP BY conv_id")
def next_turn_order(spark, sf_dir):
    """Where the next user turn goes."""
    return conversation.next_turn(table(spark, sf_dir, "conversations"))


@query(r"""
WITH u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS h FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS body FROM u""")
def clean_text_html(spark, sf_dir):
    """Pages as plain text."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@query(rf"""
WITH c AS (SELECT doc_id, {clean("text")} AS t FROM documents)
SELECT doc_id, rtrim(substr(CASE WHEN regexp_matches(t, '[.!?] ') THEN regexp_extract(t, '^(.*?[.!?]) ', 1) ELSE t END, 1, 240)) AS sentence FROM c""")
def first_sentence(spark, sf_dir):
    """The first sentence, as a short description."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query(r"""
SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^0-9a-z가-힣 \t\r\n]', ' ', 'g'), '[ \t\r\n]+'), lambda w: length(w) >= 2))) AS n_tokens FROM documents""")
def tokenize_distinct(spark, sf_dir):
    """Distinct words of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(r"""
SELECT page_id, nullif(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '') AS authority, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_host_and_params(spark, sf_dir):
    """Host and parameters of urls."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.url_authority(u).alias("authority"), text.url_parameter(u, "ref").alias("ref"), text.url_parameter(u, "page").alias("page"))


@query("SELECT p_partkey, CASE WHEN lower(trim(p_name)) = lower(trim(p_type)) THEN trim(p_name) ELSE trim(p_name) || ' ' || chr(10) || trim(p_type) END || ' ' || chr(10) || trim(p_brand) AS search_text FROM part")
def search_text_build(spark, sf_dir):
    """One text to search in, without repetitions."""
    return table(spark, sf_dir, "part").select("p_partkey", ingest.search_text(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("search_text"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, {clean("x")} AS t FROM l),
f AS (SELECT doc_id, lower(t) AS k, min(i) AS i, arg_min(t, i) AS t FROM c WHERE t IS NOT NULL GROUP BY 1, 2),
n AS (SELECT doc_id, i, t FROM f WHERE NOT (regexp_matches(t, '{arrays.JUNK_ROWS}') OR {any_of("k", arrays.NOISE_TOKENS)} OR regexp_matches(t, '�.*�') OR (length(t) > 40 AND contains(k, 'http'))
  OR (contains(t, '|') AND CAST(contains(k, 'paper') AS INT) + CAST(contains(k, 'project page') AS INT) + CAST(contains(k, 'released resources') AS INT) + CAST(contains(k, 'repo') AS INT) >= 3))),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM n)
SELECT doc_id, string_agg(substr(t, 1, 40), '|' ORDER BY i) AS terms FROM s WHERE n <= 5 GROUP BY doc_id""")
def term_list_normalize(spark, sf_dir):
    """The first five lines of each document as terms."""
    terms = F.array_join(arrays.term_list(F.split("text", "\n"), 5, 40), "|")
    return table(spark, sf_dir, "documents").select("doc_id", terms.alias("terms")).where("terms <> ''")


@query("""
SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 + 500 WHEN 2 THEN p_size * 1048576.0 WHEN 3 THEN 48000 WHEN 4 THEN p_size WHEN 5 THEN -p_size END AS BIGINT) AS bytes FROM part""")
def parse_bytes_units(spark, sf_dir):
    """Sizes with units; bare numbers are bytes."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    x = F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(n, F.lit(".5 kB of text"))).when(k % 6 == 2, F.concat(F.lit("about "), n, F.lit(" MiB"))).when(k % 6 == 3, "2,048 KB").when(k % 6 == 4, F.concat(n, F.lit(" bytes"))).otherwise(F.concat(F.lit("-"), n))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.parse_bytes(x).alias("bytes"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) WHEN 1 THEN -o_orderkey END AS as_int, CASE o_orderkey % 4 WHEN 0 THEN CAST(floor(o_totalprice) AS DOUBLE) WHEN 1 THEN -o_orderkey - 0.5 END AS as_float,
  CASE o_orderkey % 8 WHEN 2 THEN true WHEN 3 THEN false WHEN 6 THEN true WHEN 7 THEN false END AS as_bool FROM orders""")
def parse_bool_int_float(spark, sf_dir):
    """Numbers and booleans from texts."""
    k = F.col("o_orderkey")
    x = F.when(k % 4 == 0, F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" won"))).when(k % 4 == 1, F.concat(F.lit("<b>-"), k.cast("string"), F.lit(".5</b>"))).when(k % 8 == 2, " 무료 ").when(k % 8 == 3, "Private").when(k % 8 == 6, "AVAILABLE").otherwise("없음")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_int(x).alias("as_int"), numbers.parse_float(x).alias("as_float"), numbers.parse_bool(x).alias("as_bool"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'REGISTERED' WHEN toxic = 1 THEN 'PAID' WHEN quality = 0 THEN 'APPROVAL' WHEN doc_id % 7 = 0 THEN 'RESTRICTED' ELSE 'OPEN' END AS access_type FROM labels""")
def access_type_precedence(spark, sf_dir):
    """Access type by precedence of flags that may be unknown."""
    login = F.when(F.col("doc_id") % 5 != 0, F.lit(False))
    stated = F.when(F.col("doc_id") % 11 == 0, "REGISTERED").otherwise("whatever")
    kind = numbers.access_type(stated, F.col("toxic") == 1, F.col("quality") == 0, F.col("doc_id") % 7 == 0, login)
    return table(spark, sf_dir, "labels").select("doc_id", kind.alias("access_type"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, line, lower(line) AS t FROM l WHERE regexp_matches(lower(line), 'licen[cs]e|lizenz|licencia|라이선스'))
SELECT doc_id, line, CASE WHEN regexp_matches(t, '{numbers.license_pattern(numbers.LICENSE_DENIES)}') THEN false WHEN regexp_matches(t, '{numbers.license_pattern(numbers.LICENSE_ALLOWS)}') THEN true END AS commercial FROM n""")
def license_commercial_use(spark, sf_dir):
    """Commercial use from the license lines of texts."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.lower("line").rlike("licen[cs]e|lizenz|licencia|라이선스")).select("doc_id", "line", numbers.commercial_use(F.col("line")).alias("commercial"))


@query("SELECT doc_id, nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {any_of('lower(text)', w)} THEN '{n}' END" for n, w in numbers.MODALITIES.items()) + "), '') AS modalities FROM documents")
def modality_inference(spark, sf_dir):
    """Modalities that a text names."""
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.array_join(numbers.modalities(F.col("text")), ","), F.lit("")).alias("modalities"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS labelled, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS converted FROM orders")
def kst_datetime_format(spark, sf_dir):
    """Two ways to show a time: labelled as Korean, and converted to it."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.kst_labelled(d).alias("labelled"), dates.kst_converted(d.cast("timestamp")).alias("converted"))


@query(r"""
WITH c AS (SELECT doc_id, 'TITLE_SUMMARY' AS chunk_type, 0 AS chunk_order, rtrim(substr(regexp_extract(text, '^[^\r\n]*'), 1, 80)) AS chunk_text FROM documents
  UNION ALL SELECT doc_id, 'DESCRIPTION', 1, text FROM documents UNION ALL SELECT doc_id, 'TAGS', 2, 'tags: ' || lang || ', ' || source FROM documents)
SELECT doc_id, chunk_type, chunk_order, length(chunk_text) AS n_chars, md5(chunk_text) AS digest FROM c WHERE trim(chunk_text) <> ''""")
def chunk_builder_explode(spark, sf_dir):
    """Texts to embed: one row for each kind that there is."""
    d = table(spark, sf_dir, "documents")
    title = F.rtrim(F.substring(F.regexp_extract("text", r"^[^\r\n]*", 0), 1, 80))
    made = ingest.chunks(d, "doc_id", TITLE_SUMMARY=title, DESCRIPTION=F.col("text"), TAGS=F.concat(F.lit("tags: "), F.concat_ws(", ", "lang", "source")))
    return made.select("doc_id", "chunk_type", "chunk_order", F.char_length("chunk_text").cast("bigint").alias("n_chars"), F.md5("chunk_text").alias("digest"))


@query("""
SELECT page_id, 'best' || CASE WHEN page_id % 2 = 0 THEN ' for maps' ELSE '' END || chr(10) || 'ends ' || page_id AS shown FROM pages""")
def identifier_sanitize(spark, sf_dir):
    """Explanations without internal ids and source codes."""
    k = F.col("page_id").cast("string")
    period = F.when(F.col("page_id") % 2 == 0, F.lit(" (2019~2021) for maps")).otherwise(F.lit(""))
    t = F.concat(F.lit("- best dataset_id: "), k, period, F.lit("\n\n\n\nends "), k, F.lit(" ( ) source = KAGGLE, ;"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(text.sanitize_identifiers(t), r"\n+", "\n").alias("shown"))


@query(r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z가-힣]', '', 'g')) > 0 THEN round(length(regexp_replace(text, '[^가-힣]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z가-힣]', '', 'g')), 6) ELSE 0 END AS ratio FROM documents")
def hangul_ratio_validator(spark, sf_dir):
    """Share of Hangul among letters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.hangul_ratio(F.col("text")), 6).alias("ratio"))


@query(r"""
WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM n GROUP BY md5(t)""")
def near_exact_copy_dedup(spark, sf_dir):
    """The first of each set of texts that differ in case and blanks only."""
    t = F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    return table(spark, sf_dir, "documents").groupBy(t.alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""
SELECT p_partkey, p_partkey AS id, CAST(1 AS INTEGER) AS rank, CASE WHEN p_size > 1 THEN round(least(1.0, p_size / 100.0), 3) ELSE CAST(p_size AS DOUBLE) END AS score, p_name || ' {' || p_type || '}' AS reason FROM part WHERE p_partkey % 7 > 0""")
def llm_output_decode(spark, sf_dir):
    """Ranked items out of a model's answers: fences, chatter and trailing commas apart, unknown ids dropped, first of each id kept."""
    p = table(spark, sf_dir, "part")
    ids = p.select(F.col("p_partkey").alias("id"))
    key = F.col("p_partkey").cast("string")
    reason = F.concat("p_name", F.lit(" {"), "p_type", F.lit("}"))
    answer = F.concat(
        F.lit('Here you are:\n```json\n{"items": [{"id": '), key, F.lit(', "rank": 1, "score": '), F.col("p_size").cast("string"), F.lit(', "reason": "'), reason,
        F.lit('"}, {"id": 999999999, "rank": 2, "score": 0.5, "reason": "made up"}, {"id": '), key, F.lit(', "rank": 3, "score": 0, "reason": "again"},]}\n``` Bye }'),
    )
    answer = F.when(F.col("p_partkey") % 7 == 0, F.lit('{"items": [{"id": 1, ')).otherwise(answer)  # cut off
    rows = p.select("p_partkey", F.posexplode(nested.ranked_items(answer)).alias("position", "item")).select("p_partkey", "position", "item.*")
    first = tables.latest(rows.join(ids, "id", "left_semi"), ["p_partkey", "id"], F.asc("position"))
    return first.select("p_partkey", "id", "rank", numbers.unit_score(F.col("score")).alias("score"), "reason")
