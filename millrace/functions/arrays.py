"""Array functions: order is kept, first occurrences win."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text


def unique_ci(a: Column) -> Column:
    """Cleaned strings that are not blank, without repetitions in other case; the first spelling stays. For short lists."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("seen"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        more = F.struct(F.concat(acc["seen"], F.array(F.lower(x))).alias("seen"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(x.isNull() | F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(more)

    return F.aggregate(F.transform(a, text.clean), start, add, lambda acc: acc["out"])


def merged(*lists: Column) -> Column:
    """All lists in order, without repetitions in other case."""
    return unique_ci(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in lists)))


def term_list(a: Column, items: int, longest: int, strict: bool = False) -> Column:
    """``unique_ci`` without noise, terms cut to ``longest`` characters, at most ``items`` of them."""
    kept = F.filter(unique_ci(a), lambda t: ~(noise(t) | sentence_like(t)) if strict else ~noise(t))
    return F.slice(F.transform(kept, lambda t: F.substring(t, 1, longest)), 1, items)


def short_terms(a: Column, longest: int = 80, tasks: bool = False) -> Column:
    """``unique_ci`` of the terms up to ``longest`` characters that are no noise: longer ones are left out, not cut."""

    def fits(t: Column) -> Column:
        bad = noise(t) | (F.char_length(t) > 90) | ((F.char_length(t) > 45) & (F.size(F.split(t, " ")) >= 6)) | F.lower(t).rlike("오픈데이터포털|government 24")
        return (F.char_length(t) <= longest) & ~((bad | (t.contains(". ") & t.rlike("[가-힣]"))) if tasks else bad)

    return F.filter(unique_ci(a), fits)


#: Rows of tables and pages that catalogues mix up with terms.
JUNK_ROWS = r"^(?:텍스트|동영상|기타)\s+전체\s+행\s+[0-9]+\s+확장자\s+[A-Z0-9]+(?:\s+누적)?$|^JSON\s+활용신청\s+[0-9]+\s+데이터\s+한계\s+키워드(?:\s+.+)?$"
NOISE_TOKENS = ("추천데이터", "로그인하셔서", "개인정보처리방침", "open data portal", "privacy policy")


def noise(t: Column) -> Column:
    """Navigation, rows of other tables, notices, broken characters and long urls in place of a term."""
    lower = F.lower(t)
    return text.is_navigation(t) | t.rlike(JUNK_ROWS) | lower.rlike("|".join(NOISE_TOKENS)) | t.rlike("(?s)\ufffd.*\ufffd") | (lower.contains("http") & (F.char_length(t) > 40))


def sentence_like(t: Column) -> Column:
    """Long runs of words, and Korean text with a full stop inside."""
    return ((F.char_length(t) > 45) & (F.size(F.split(t, r"\s+")) >= 6)) | (t.contains(". ") & t.rlike("[가-힣]"))


def first_shortest(a: Column) -> Column:
    """The shortest string, the first of equals."""
    ordered = F.array_sort(F.transform(a, lambda x, i: F.struct(F.char_length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.get(ordered, F.lit(0))["x"]


def listed(j: Column) -> Column:
    """A JSON list of strings as an array, a JSON string or any other text as an array of one; null as none."""

    def read(y: Column) -> Column:
        inner = F.when(F.trim(y).startswith("["), F.from_json(y, "array<string>"))
        return F.coalesce(inner, F.when(y.isNotNull(), F.array(y)), F.array().cast("array<string>"))

    return text.let(j, read)


def hosts(urls: Column) -> Column:
    """Distinct hosts of urls."""
    return unique_ci(F.transform(urls, lambda u: text.url_authority(u)))


def positive_ids(a: Column) -> Column:
    """Distinct ids; null if any is not positive."""
    return F.when(~F.exists(a, lambda x: x <= 0), F.array_distinct(a))


def chunked(a: Column, size: int) -> Column:
    """Arrays of ``size`` items."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, F.lit(size)))
