"""The queries of this subpackage, with production parameters over whole tables, and SQL where SQL can express them."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat_format, conversation_repair, decontamination, html_extract, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scan, source_audit, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(_table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ",", "null"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.production_conversations(_table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_turns(rows))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_repairs(_table(spark, sf_dir, "conversations"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_url_filter, op3_suffix_dedup, op4_ngram_join, op5_html_extract, op6_pii, op7_decontamination, op8_packing, op9_quality_classifier, op10_chat_format, op11_conversation_repair, op12_source_audit, op13_secret_scan, pipeline)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _counted(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _distance(name: str, share: str) -> str:
    """Jensen-Shannon distance of each document's shares ``share`` (doc_id, language, bin, p; zero shares left out) to its language's mean."""
    return f"""
{name}_n AS (SELECT language, count(DISTINCT doc_id) AS docs FROM {share} GROUP BY language),
{name}_q AS (SELECT s.language, bin, sum(p) / max(docs) AS q FROM {share} s JOIN {name}_n ON {name}_n.language = s.language GROUP BY s.language, bin),
{name} AS (SELECT doc_id, round(sqrt(greatest(0, least(1, (sum(p * log2(2 * p / (p + q))) + sum(q * log2(2 * q / (p + q))) + 1 - sum(q)) / 2))), 6) AS distance
           FROM {share} s JOIN {name}_q USING (language, bin) GROUP BY doc_id)"""



def _least(*candidates: str) -> str:
    return f"list_sort([{', '.join(candidates)}])[1]"


def _edit(state: int, cost: str, letter: str, told: str | None = None) -> str:
    """The best way to a state (from 1) of ``s``, one edit longer."""
    text = f"s[{state}].r || [{told}]" if told else f"s[{state}].r"
    return f"{{'c': s[{state}].c + {cost}, 'a': s[{state}].a || '{letter}', 'r': {text}}}"


#: Two rounds of inserted rows over the ways ``s`` to the states nothing, system, user, assistant.
_USER, _ASSISTANT = "'user:'", "'assistant:'"
_INSERT = f"[s[1], s[2], {_least('s[3]', *(_edit(k, '3', 'I', _USER) for k in (1, 2, 4)))}, {_least('s[4]', _edit(3, '3', 'I', _ASSISTANT))}]"
_STEP = f"""[{_edit(1, '4', 'D')},
 {_least(_edit(2, '4', 'D'), _edit(1, "keep + if(x = 's', 0, 1000000000)", 'K', "role || ':' || text"))},
 {_least(_edit(3, '4', 'D'), *(_edit(k, "keep + if(x = 'u', 0, 1000000000)", 'K', "role || ':' || text") for k in (1, 2, 4)), *(_edit(k, 'keep + 3', 'R', "'user:' || text") for k in (1, 2, 4)))},
 {_least(_edit(4, '4', 'D'), _edit(3, "keep + if(x = 'a', 0, 1000000000)", 'K', "role || ':' || text"), _edit(3, 'keep + 3', 'R', "'assistant:' || text"))}]"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN {quality_rules.LANGUAGES!r} THEN lang ELSE 'other' END AS language,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) x(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(0, 3) y(j) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (SELECT doc_id, language, unnest(range(0, 7)) AS bin, unnest([{_counted('[a-z]')}, {_counted('[A-Z]')}, {_counted('[0-9]')}, {_counted(r'[\x20\x09-\x0D]')},
      {_counted(r'[.,;:!?\x27"()-]')}, {_counted(r'[\x00-\x08\x0E-\x1F\x7F#$%&*+/<=>@\[\\\]^_`{|}~]')}, {_counted(r'[^\x00-\x7F]')}]) AS k, length(t) AS total FROM d),
cs AS (SELECT doc_id, language, bin, k / total AS p FROM c WHERE k > 0),
v AS (SELECT doc_id, language, translate(unnest(w), '{_UPPER}', '{_LOWER}') AS x, len(w) AS total FROM d),
b AS (SELECT doc_id, language, total, CASE WHEN strlen(x) > 1 THEN regexp_replace(x, '[.,;:!?]$', '') ELSE x END AS x FROM v),
ws AS (SELECT doc_id, language, bin, count(*) / max(total) AS p FROM (SELECT *, CASE WHEN x IN {quality_rules.COMMON_WORDS!r} THEN x ELSE '' END AS bin FROM b) GROUP BY doc_id, language, bin),
{_distance("cd", "cs")}, {_distance("wd", "ws")},
f AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars, CAST({_counted('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
        CASE WHEN length(t) >= {quality_rules.MIN_CHARS} THEN coalesce(cd.distance, 0) ELSE 0 END AS char_distance,
        CASE WHEN len(w) >= {quality_rules.MIN_WORDS} THEN coalesce(wd.distance, 0) ELSE 0 END AS word_distance
      FROM d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND char_distance <= {quality_rules.MAX_CHAR_DISTANCE} AND word_distance <= {quality_rules.MAX_WORD_DISTANCE} AS kept FROM f""",
    "op4_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) x(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.y, r.label FROM r JOIN u ON u.x = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(label) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op2_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, '.' || host AS d,
        list_filter({list(url_filter.BLOCKED_HOSTS)!r}, lambda x: ends_with('.' || host, '.' || x)) AS listed FROM h),
v AS (SELECT page_id, host, path, listed[1] AS listed_host,
        CASE WHEN ends_with(d, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN ends_with(d, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN ends_with(d, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN ends_with(d, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN ends_with(d, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed_host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed_host
FROM v""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|unk>|pad>|INST\]|/INST\]|<SYS>>|</SYS>>|\|[A-Za-z0-9_]+\|>)', '\1\\\2\3', 'g') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(safe) + 25) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE k AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
c AS (SELECT *, xor(list_reduce(bytes, lambda c, b: list_reduce(range(8), lambda z, i: xor(z >> 1, CAST(3988292384 AS BIGINT) * (z & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
o AS (SELECT *, substr(role, 1, 1) AS x, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o)),
r AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000000 END AS keep FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
w(conv_id, i, s) AS (
  SELECT conv_id, CAST(0 AS BIGINT), s FROM (SELECT conv_id, {_INSERT} AS s FROM (SELECT conv_id, {_INSERT} AS s FROM (SELECT DISTINCT conv_id,
    [{{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}}, {{'c': 1000000000, 'a': '', 'r': []}}, {{'c': 1000000000, 'a': '', 'r': []}}, {{'c': 1000000000, 'a': '', 'r': []}}] AS s FROM conversations)))
  UNION ALL
  SELECT conv_id, i, {_INSERT} FROM (SELECT conv_id, i, {_INSERT} AS s FROM (SELECT w.conv_id, r.i, {_STEP} AS s FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
l AS (SELECT conv_id, list_sort([s[1], s[4]])[1] AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM l LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM l.conv_id""",
    "op12_source_audit": rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT d, lang, source, unnest(w) AS w FROM d),
k AS (SELECT lang, w, count(*) AS n FROM t GROUP BY lang, w HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, w, count(*) AS n FROM t SEMI JOIN k USING (lang, w) GROUP BY lang, source, w),
g AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.w, coalesce(c.n, 0) AS count, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (v.n + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, w)),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
      UNION ALL SELECT a.lang, a.source, 'pair', b.source, sum((a.p - b.p) * (a.p - b.p) // b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY a.lang, a.source, b.source
      UNION ALL SELECT lang, source, 'term', w, (p - q) * (p - q) // q FROM p WHERE count > 0 AND p > q),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200""",
}
