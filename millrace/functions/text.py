"""Text functions: Column to Column, no UDFs."""

import json
import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space.
_BLANKS = r"[\s\p{Z}\x{85}]+"
_ENDS = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_NAMES = json.dumps({n: chr(c) for n, c in (*name2codepoint.items(), ("apos", 39))})


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def unescape(x: Column) -> Column:
    """Character references (numeric ones, and the named ones of HTML 4) decoded, each once; unknown names stay."""

    def decoded(piece: Column) -> Column:
        name = F.substring(piece, F.lit(2), F.char_length(piece) - 2)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).try_cast("int")
        number = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        known = F.try_element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), name)
        return F.when(~piece.rlike(f"^{_REFERENCE}$"), piece).when(name.startswith("#"), number).otherwise(F.coalesce(known, piece))

    def pieces(y: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(y, F.lit(rf"{_REFERENCE}|[^&]+|&"), F.lit(0)), decoded), "")

    return let(x, lambda y: F.when(y.contains("&"), pieces(y)).otherwise(y))


def one_line(x: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(x, _BLANKS, " "))


def clean(x: Column) -> Column:
    """References decoded, tags and repeated blanks out, ends trimmed; null if nothing is left."""
    return let(one_line(F.regexp_replace(unescape(x), "<[^>]+>", " ")), lambda t: F.when(t != "", t))


def html_text(x: Column) -> Column:
    """``clean`` of a page without its scripts and styles."""
    return clean(F.regexp_replace(x, r"(?is)<(script|style)\b.*?</(script|style)>", " "))


def lines(x: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(unescape(x), r"\r?\n"), lambda s: F.regexp_replace(s, _ENDS, "")), lambda s: s != "")


def first_sentence(x: Column, longest: int = 240) -> Column:
    """The cleaned text up to the first ``.``, ``!`` or ``?`` that white space follows, cut to ``longest``."""
    return F.rtrim(F.substring(F.get(F.split(clean(x), r"(?<=[.!?])\s+", 2), F.lit(0)), 1, longest))


def clip(x: Column, n: int) -> Column:
    """Trimmed, on one line, and no longer than ``n`` with its dots."""
    one = F.replace(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit("\n"), F.lit(" "))
    return let(one, lambda y: F.when(F.char_length(y) > n, F.concat(F.substring(y, 1, n - 3), F.lit("..."))).otherwise(y))


def clip_display(x: Column, n: int) -> Column:
    """Line ends unified, at most one empty line in a row, no blanks at line ends, clipped."""
    text = F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, _ENDS, "")
    return F.when(F.char_length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n - 3), r"[\s\p{Z}]+$", ""), F.lit("..."))).otherwise(text)


def tokens(x: Column) -> Column:
    """Distinct lower-case words of two characters or more (Latin letters, digits, Hangul)."""
    words = F.split(F.regexp_replace(F.lower(x), "[^0-9a-z가-힣 \t\r\n]", " "), r"[ \t\r\n]+")
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 2))


#: Words of a request that say nothing about its subject, for each kind of catalogue, and pieces of such words for both.
DATASET_STOP = ("openapi", "open_api", "api", "apis", "오픈api", "오픈_api", "오픈")
API_STOP = ("데이터셋", "dataset", "datasets", "data_set")
REQUEST_NOISE = ("추천", "프로젝트", "만들", "원해", "원하는", "원하는데", "싶", "해줘", "해주세요", "알려")


def query_terms(words: Column, stop: tuple[str, ...], api_words: bool = False) -> Column:
    """The words without ``stop`` and request noise (with ``api_words``, also without those that name APIs); all of them if none is left."""

    def says_something(w: Column) -> Column:
        keep = ~w.isin(*stop) & ~w.rlike("|".join(REQUEST_NOISE))
        return keep & ~w.endswith("api") & ~w.startswith("openapi") if api_words else keep

    kept = F.filter(words, says_something)
    return F.when(F.size(kept) > 0, kept).otherwise(words)


#: How internal ids and source codes are written in explanations.
_IDS = r"(?i)(?:^|[^0-9A-Za-z가-힣])(?:dataset|openapi)[_\s-]*id\s*[:=]?\s*[0-9]+(?:\s*\(\s*[0-9]{4}\s*[~-]\s*[0-9]{4}\s*\))?(?=$|[^0-9A-Za-z가-힣])"
_SOURCES = r"(?i)(?:^|[^0-9A-Za-z])(?:src|source|source_code)\s*[:=]\s*[^;,\n]+"


def sanitize_identifiers(x: Column) -> Column:
    """Without ids such as ``datasetId=12``, source codes, and the brackets that they leave empty."""
    for pattern, to in ((_IDS, ""), (_SOURCES, ""), (r"\(\s*\)", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"^[ \-;,:\n]+|[ \-;,:\n]+$", "")):
        x = F.regexp_replace(x, pattern, to)
    return x


def strip_markdown(x: Column) -> Column:
    """Plain text of light markdown: fences, headings, bullets, quotes, emphasis, links and rules."""
    for pattern, to in (
        (r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""), (r"(?m)^\s*(?:-{3,}|\*{3,})\s*$", ""), (r"\*\*|__|\*|~~", ""), (r"\s+", " "),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def sentences(x: Column, least: int = 1) -> Column:
    """Sentences and lines of ``least`` characters or more; the whole text if none is as long."""
    parts = F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), one_line), lambda s: s != "")
    long = F.filter(parts, lambda s: F.char_length(s) >= least)
    return F.when(F.size(long) > 0, long).when(one_line(x) != "", F.array(x)).otherwise(F.array().cast("array<string>"))


def pairs_of_sentences(all_: Column, per: int = 2) -> Column:
    """Sentences, ``per`` to a paragraph, with an empty line between."""
    starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(per))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: F.array_join(F.slice(all_, i, F.lit(per)), " ")), "\n\n")


def paragraphs(x: Column, per: int = 2) -> Column:
    """The text's sentences, ``per`` to a paragraph."""
    return pairs_of_sentences(sentences(x), per)


def split_long(x: Column, longest: int = 220, reach: int = 60, at_sentence: bool = False) -> Column:
    """Two paragraphs for texts above ``longest``: cut at the last blank within ``reach`` of the middle, or, if asked, after the first sentence."""
    middle = F.floor(F.char_length(x) / 2).cast("int")
    low = F.greatest(middle - reach, F.lit(0))
    some = F.substring(x, low + 1, F.least(middle + reach, F.char_length(x)) - low)
    back = F.instr(F.reverse(some), " ")
    at = F.when(back > 0, low + F.char_length(some) - back)
    left, right = F.trim(F.substring(x, F.lit(1), at)), F.trim(F.substring(x, at + 2, F.char_length(x)))
    out = F.when((at > 0) & (left != "") & (right != ""), F.concat(left, F.lit("\n\n"), right)).otherwise(x)
    if at_sentence:
        halves = F.split(x, r"(?<=[.?!])\s+", 2)
        first, rest = F.trim(F.get(halves, F.lit(0))), F.trim(F.get(halves, F.lit(1)))
        out = F.when((first != "") & (rest != ""), F.concat(first, F.lit("\n\n"), rest)).otherwise(out)
    return F.when(F.char_length(x) > longest, out).otherwise(x)


def hangul_ratio(x: Column) -> Column:
    """Hangul syllables among letters; 0 without letters."""
    letters = F.regexp_replace(x, "[^A-Za-z가-힣]+", "")  # runs, not characters: a match costs more than a step in it
    ratio = let(letters, lambda y: F.try_divide(F.char_length(F.regexp_replace(y, "[A-Za-z]+", "")), F.char_length(y)))
    return F.when(x.rlike("[가-힣]"), ratio).otherwise(F.lit(0.0))


#: How many sentences a merged explanation has, and how Korean it is.
MERGED_SENTENCES = (4, 12)
MERGED_HANGUL = 0.45


def plain_of_markdown(x: Column) -> Column:
    """What a validator reads of light markdown: fences, tags, images, marks of headings, bullets and emphasis gone."""
    for pattern, to in (
        (r"(?s)```.*?```", " "), (r"(?s)~~~.*?~~~", " "), (r"</?[a-zA-Z][^>]*>", " "), (r"`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?:^|\n)\s{0,3}#{1,6}\s*", " "), (r"(?:^|\n)\s*(?:[-*+] |[0-9]+\.\s+)", " "), (r"[*_~>]", " "),
    ):
        x = F.regexp_replace(x, pattern, to)
    return one_line(x)


def merged_text_code(shown: Column, raw: Column, dataset: bool = True, openapi: bool = True) -> Column:
    """Why a merged explanation (as shown, and as the model gave it) is not fit to show, or null."""
    return let(plain_of_markdown(shown), lambda plain: _merged_code(shown, raw, plain, dataset, openapi))


def _merged_code(shown: Column, raw: Column, plain: Column, dataset: bool, openapi: bool) -> Column:
    n = let(F.size(sentences(plain, 6)), lambda k: F.when(k < MERGED_SENTENCES[0], "too_short").when(k > MERGED_SENTENCES[1], "too_long"))
    code = (
        F.when(F.coalesce(shown, F.lit("")) == "", "empty")
        .when(raw.contains("```") | raw.contains("~~~"), "markdown_code_block")
        .when(raw.rlike(r"</?[a-zA-Z][^>]*>"), "html_tag")
    )
    late = F.when(hangul_ratio(plain) < MERGED_HANGUL, "low_korean_ratio")
    if dataset:
        late = late.when(~plain.contains("데이터"), "missing_dataset_perspective")
    if openapi:
        late = late.when(~F.lower(plain).contains("api"), "missing_openapi_perspective")
    return code.otherwise(F.coalesce(n, late))


#: A navigation line of project pages, and its labels.
_NAVIGATION = r"(?i)(?:📑\s*)?paper\s*\|\s*(?:🌐\s*)?project\s*page\s*\|\s*(?:💾\s*)?released\s*resources\s*\|\s*(?:📦\s*)?repo"
_NAVIGATION_LABELS = ("paper", "project page", "released resources", "repo")


def is_navigation(x: Column) -> Column:
    """Whether a text is a project page's navigation: its line, or three of its labels and a bar."""
    hits = sum((F.lower(x).contains(w).cast("int") for w in _NAVIGATION_LABELS), F.lit(0))
    return x.contains("|") & (x.rlike(_NAVIGATION) | (hits >= 3))  # the line has bars too


def without_navigation(x: Column) -> Column:
    """The cleaned text without navigation lines; null if it is nothing else."""
    return let(clean(F.regexp_replace(x, _NAVIGATION, " ")), lambda rest: F.when(~is_navigation(rest), rest))


def uuid_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(x), "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", 0), F.lit(""))


def hashtags(x: Column) -> Column:
    """What follows each ``#``, up to the next one."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"#([^#\s]+(?:\s+[^#\s]+)*)"), F.lit(1)), clean), lambda t: t.isNotNull()))


def split_keywords(x: Column) -> Column:
    """At ``;`` if there is one, else at ``,`` if there is one, else at ``/``."""
    parts = let(x, lambda y: F.when(F.contains(y, F.lit(";")), F.split(y, ";")).when(F.contains(y, F.lit(",")), F.split(y, ",")).otherwise(F.split(y, "/")))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def split_terms(x: Column) -> Column:
    """At ``,``, ``|``, ``;``, ``/``, newlines and tabs; at `` - `` if there is none of them."""
    parts = F.split(x, r"[,|;/\n\t]+")
    return F.coalesce(F.filter(F.transform(F.when(F.size(parts) > 1, parts).otherwise(F.split(x, " - ")), lambda p: F.trim(p)), lambda p: p != ""), F.array().cast("array<string>"))


def prefixed(tags: Column, prefix: str) -> Column:
    """What follows ``prefix`` in the tags that start with it."""
    return F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.substring(t, F.lit(len(prefix) + 1), F.char_length(t)))


def url_authority(x: Column) -> Column:
    """Lower-case host with user and port, if any; null for anything but http(s) urls."""
    return F.nullif(F.lower(F.regexp_extract(x, r"^https?://([^/?#]+)", 1)), F.lit(""))


def url_parameter(x: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(x, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def slug(x: Column, longest: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^0-9a-z가-힣]+", "-"), "^-+|-+$", ""), 1, longest)


def markdown_link(x: Column) -> Column:
    """struct(name, url) of the first link."""
    return F.struct(F.nullif(F.regexp_extract(x, r"\[([^\]]+)\]\(([^)\s]+)\)", 1), F.lit("")).alias("name"), F.nullif(F.regexp_extract(x, r"\[([^\]]+)\]\(([^)\s]+)\)", 2), F.lit("")).alias("url"))


def version_suffix(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"[_-]([0-9]{8}|v[0-9]+(?:\.[0-9]+)*)$", 1), F.lit(""))


def labelled_values(x: Column, labels: list[str]) -> Column:
    """map(label, value) of a flattened table: a value goes from its label (and a colon, if any) to the next label; of a label's values the last counts."""
    every = "|".join(re.escape(n) for n in sorted(labels, key=len, reverse=True))
    pairs = F.regexp_extract_all(clean(x), F.lit(rf"(?:{every})(?:(?!{every}).)*"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, rf"^({every})", 1).alias("key"), F.regexp_replace(F.regexp_replace(p, rf"^(?:{every})", ""), r"^[ :]+|[ :]+$", "").alias("value")))

    def last(filled: Column, after: Column) -> Column:
        return F.filter(filled, lambda e, i: F.size(after) - F.array_position(after, e["key"]) == i)

    filled = F.filter(entries, lambda e: e["value"] != "")
    return let(filled, lambda f: let(F.reverse(F.transform(f, lambda e: e["key"])), lambda after: F.map_from_entries(last(f, after))))


def error_text(x: Column, longest: int = 360) -> Column:
    """On one line, without secrets, clipped; null if blank."""
    one = one_line(F.regexp_replace(x, r"(?i)(bearer\s+|api[_-]?key\s*[=:]\s*|token\s*[=:]\s*)[^\s\"',]+", "$1***"))
    return F.nullif(F.when(F.char_length(one) > longest, F.concat(F.substring(one, 1, longest - 3), F.lit("..."))).otherwise(one), F.lit(""))


def failure_summary(dataset: Column, openapi: Column) -> Column:
    """What failed, of both kinds, in one clipped text."""
    parts = F.concat_ws(" | ", F.concat(F.lit("dataset="), blank_to_null(dataset)), F.concat(F.lit("openapi="), blank_to_null(openapi)))
    return F.when(parts == "", "추천 생성 중 오류가 발생했습니다.").otherwise(error_text(parts))


def cut(x: Column, longest: int) -> Column:
    """The first ``longest`` characters, without a mark that there were more."""
    return F.substring(x, 1, longest)


def labelled(label: str, x: Column) -> Column:
    """``label: value`` on a line; null where there is no value."""
    return F.concat(F.lit(f"{label}: "), F.nullif(F.trim(x), F.lit("")))


def labelled_list(label: str, a: Column) -> Column:
    """``label: a, b`` of the items that are not blank; null where there are none."""
    kept = F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}: "), F.array_join(kept, ", ")))


def labelled_json(label: str, x: Column) -> Column:
    """``label: json`` of a struct, map or array; null where that is empty."""
    shown = F.to_json(x)
    return F.when(~shown.isin("{}", "[]"), F.concat(F.lit(f"{label}: "), shown))


def joined_lines(*parts: Column) -> Column:
    """The parts that there are, a line each."""
    return F.concat_ws("\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts))
