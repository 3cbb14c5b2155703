"""Answers of a model as light markdown: Column to Column. Answers are short; their lines are folded over once, with two counters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text

HEADINGS, BULLETS = 2, 5
_STRUCTURED = r"(?m)^(?:###\s+|-\s+)"


def light(x: Column, without_tables: bool = False) -> Column:
    """At most HEADINGS headings (all of one level) and BULLETS bullets, further ones as plain lines; quote marks out, blanks single."""
    lines = F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(text.one_line(s), r"^>\s*", ""))
    if without_tables:
        lines = F.filter(lines, lambda s: ~s.rlike(r"^\|.*\|$"))

    def mark(s: Column) -> Column:
        heading, bullet = F.regexp_extract(s, r"^#{1,6}\s*(.+)$", 1), F.regexp_extract(s, r"^(?:[-*+]\s+|[0-9]+\.\s+)(.+)$", 1)
        kind = F.when(heading != "", "h").when(bullet != "", "b").otherwise("")
        return F.struct(kind.alias("kind"), F.when(heading != "", heading).when(bullet != "", bullet).otherwise(s).alias("text"))

    def put(acc: Column, s: Column) -> Column:
        head = (s["kind"] == "h") & (acc["h"] < HEADINGS)
        item = (s["kind"] == "b") & (acc["b"] < BULLETS)
        line = F.when(head, F.concat(F.lit("### "), s["text"])).when(item, F.concat(F.lit("- "), s["text"])).otherwise(s["text"])
        return F.struct((acc["h"] + head.cast("int")).alias("h"), (acc["b"] + item.cast("int")).alias("b"), F.concat(acc["out"], F.array(line)).alias("out"))

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("b"), F.array().cast("array<string>").alias("out"))
    joined = F.array_join(F.aggregate(F.transform(lines, mark), start, put, lambda acc: acc["out"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _without_fences(x: Column) -> Column:
    for pattern in (r"(?s)```.*?```", r"(?s)~~~.*?~~~", r"</?[a-zA-Z][^>]*>"):
        x = F.regexp_replace(x, pattern, " ")
    return x


def in_paragraphs(x: Column, at_sentence: bool = False, least: int = 1) -> Column:
    """Text with headings, bullets or paragraphs as it is; else its sentences two by two, and long ones parted."""
    parts = F.filter(F.transform(F.split(x, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    sentences = text.sentences(x, least)
    return (
        F.when(x.rlike(_STRUCTURED), x)
        .when(F.size(parts) >= 2, F.array_join(parts, "\n\n"))
        .when(F.size(sentences) <= 2, text.split_long(x, at_sentence=at_sentence))
        .otherwise(text.pairs_of_sentences(sentences))
    )


def reason(x: Column) -> Column:
    """A ranking's reason, ready to show."""
    return text.let(light(_without_fences(F.replace(x, F.lit("\r\n"), F.lit("\n")))), lambda y: in_paragraphs(y))


def chat(x: Column) -> Column:
    """A chat answer: tables out; lines of plain paragraphs joined."""
    out = light(_without_fences(F.replace(x, F.lit("\r\n"), F.lit("\n"))), without_tables=True)
    joined = text.let(out, lambda y: F.when(y.rlike(_STRUCTURED), y).otherwise(F.regexp_replace(y, r"(?<!\n)\n(?!\n)", " ")))
    return text.let(joined, lambda y: in_paragraphs(y, at_sentence=True))


def merged(x: Column) -> Column:
    """A merged explanation: ids and source marks out."""
    plain = F.replace(F.replace(text.sanitize_identifiers(x), F.lit("[D]"), F.lit("")), F.lit("[O]"), F.lit(""))
    return text.let(light(F.replace(plain, F.lit("\r\n"), F.lit("\n"))), lambda y: in_paragraphs(y, at_sentence=True, least=6))


def reason_context(x: Column, lines: int = 20, longest: int = 3600) -> Column:
    """The first lines of a reason, without ids, clipped."""
    kept = F.filter(F.transform(F.split(x, r"\r?\n"), lambda s: text.sanitize_identifiers(F.trim(s))), lambda s: s != "")
    return F.when(F.size(kept) > 0, text.clip(F.array_join(F.slice(kept, 1, lines), "\n"), longest)).otherwise("추천 근거 요약은 내부 식별자 제거 정책에 따라 정리되었습니다.")


def reason_points(x: Column, most: int = 2) -> Column:
    """Up to ``most`` different points of a reason: what follows a number or a name, of 8 characters or more."""

    def point(s: Column) -> Column:
        s = F.regexp_replace(text.sanitize_identifiers(F.trim(s)), r"^\[[0-9]+\]\s*", "")
        s = F.trim(F.regexp_replace(s, "^.*? - ", ""))
        return text.clip(F.regexp_replace(s, r"^[-* ]+|[-* ]+$", ""), 140)

    return F.slice(F.array_distinct(F.filter(F.transform(F.split(x, r"\r?\n"), point), lambda p: F.char_length(p) >= 8)), 1, most)


def ensured_sentence(x: Column) -> Column:
    return text.let(x, lambda y: F.when(y.rlike(r"[.!?]$"), y).otherwise(F.concat(y, F.lit("."))))


def fallback_explanation(prompt: Column, dataset_reason: Column, openapi_reason: Column) -> Column:
    """The explanation in place of a model's: the request, two points of each reason, and a caution."""
    return text.let(reason_points(dataset_reason), lambda d: text.let(reason_points(openapi_reason), lambda o: _fallback(prompt, d, o)))


def _fallback(prompt: Column, d: Column, o: Column) -> Column:
    pick = lambda points, i, other: F.coalesce(F.get(points, F.lit(i)), F.lit(other))
    first = F.concat(F.lit("요청하신 '"), text.clip(prompt, 80), F.lit("' 목적을 기준으로 데이터셋과 Open API 추천 근거를 함께 검토했습니다"))
    second = F.concat(F.lit("데이터셋 측면에서는 "), pick(d, 0, "요청 의도와 유사한 데이터 속성을 우선 반영했습니다"), F.lit(" 또한 "), pick(d, 1, "접근 조건과 활용 난이도를 함께 고려해 후보를 정리했습니다"))
    third = F.concat(F.lit("Open API 측면에서는 "), pick(o, 0, "Open API 후보의 제공 범위와 인증 방식을 중심으로 정리했습니다"), F.lit(" 또한 "), pick(o, 1, "실제 연계 시 필요한 제약 조건을 함께 검토했습니다"))
    last = F.lit("근거가 제한된 항목은 확인 필요로 보고, 실제 적용 전 최신 문서와 접근 권한을 점검하는 것을 권장합니다.")
    return F.concat_ws("\n\n", ensured_sentence(first), ensured_sentence(second), ensured_sentence(third), last)


#: How lines begin that introduce a part of an answer rather than give a reason.
CARD_HEADS = ("요약 추천", "마무리 제안", "실무 적용 아키텍처", "실행을 위한 구체적 체크리스트")


def card_reason(x: Column, longest: int = 160) -> Column:
    """The first line that gives a reason, clipped; null without one."""
    kept = F.filter(F.transform(F.split(x, r"\r?\n"), text.one_line), lambda s: (s != "") & ~s.rlike("^(" + "|".join(CARD_HEADS) + ")"))
    line = F.get(kept, F.lit(0))
    return F.when(F.char_length(line) > longest, F.concat(F.rtrim(F.substring(line, 1, longest - 3)), F.lit("..."))).otherwise(line)
