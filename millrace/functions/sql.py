"""Text and number rules as functions of SQL: temporary SQL functions, which Catalyst inlines, and one table function in Python.

They say the same as the Column rules in ``text``, ``numbers`` and ``arrays``, and share their patterns and words.
"""

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.functions import numbers, text


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(map(_quoted, words))


_REFERENCE = _quoted(f"^{text._REFERENCE}$")
_NAME = "substr(p, 2, char_length(p) - 2)"
_CODE = f"try_cast(CASE WHEN {_NAME} RLIKE '^#[xX]' THEN conv(substr({_NAME}, 3, 8), 16, 10) WHEN startswith({_NAME}, '#') THEN substr({_NAME}, 2, 8) END AS INT)"
_CHAR = f"CASE WHEN {_CODE} > 0 AND {_CODE} < 1114112 AND NOT {_CODE} BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex({_CODE}), 8, '0')), 'UTF-32') ELSE '�' END"


def _unescaped(x: str) -> str:
    named = f"coalesce(try_element_at(from_json({_quoted(text._NAMES)}, 'map<string,string>'), {_NAME}), p)"
    one = f"CASE WHEN NOT p RLIKE {_REFERENCE} THEN p WHEN startswith({_NAME}, '#') THEN {_CHAR} ELSE {named} END"
    pieces = f"array_join(transform(regexp_extract_all(y, {_quoted(text._REFERENCE + '|[^&]+|&')}, 0), p -> {one}), '')"
    return f"get(transform(array({x}), y -> CASE WHEN contains(y, '&') THEN {pieces} ELSE y END), 0)"


def _clean(x: str) -> str:
    return f"get(transform(array(trim(regexp_replace(regexp_replace({_unescaped(x)}, '<[^>]+>', ' '), {_quoted(text._BLANKS)}, ' '))), t -> CASE WHEN t <> '' THEN t END), 0)"


_UNITS = ", ".join(f"'{name}', {float(size)!r}D" for name, size in numbers.UNITS.items())
_AMOUNT, _UNIT = (f"nullif(regexp_extract(tidy_text(x), {_quoted(numbers._SIZE)}, {k}), '')" for k in (1, 2))

#: What each function takes and gives, and the expression that it is; a function may use those before it.
FUNCTIONS = {
    "tidy_text": ("x STRING", "STRING", _clean("x")),
    "as_bool": ("x STRING", "BOOLEAN", f"CASE WHEN lower(tidy_text(x)) IN ({_words(numbers.TRUE_WORDS)}) THEN true WHEN lower(tidy_text(x)) IN ({_words(numbers.FALSE_WORDS)}) THEN false END"),
    "as_int": ("x STRING", "BIGINT", "try_cast(nullif(regexp_extract(replace(tidy_text(x), ',', ''), '-?[0-9]+', 0), '') AS BIGINT)"),
    "as_bytes": ("x STRING", "BIGINT", f"coalesce(floor(CAST({_AMOUNT} AS DOUBLE) * element_at(map({_UNITS}), lower({_UNIT}))), as_int(x))"),
    "distinct_fold": (
        "xs ARRAY<STRING>", "ARRAY<STRING>",
        f"""get(transform(array(transform(xs, x -> {_clean('x')})), cs -> get(transform(array(transform(cs, c -> lower(c))),
            ls -> filter(cs, (c, i) -> c IS NOT NULL AND array_position(ls, get(ls, i)) = i + 1)), 0)), 0)""",
    ),
}


@udtf(returnType="nth int, part string")
class TextParts:
    """The parts of a text of at most ``size`` characters, cut behind blanks where there are any."""

    def eval(self, body: str, size: int) -> Iterator[tuple[int, str]]:
        at, nth = 0, 0
        while body and at < len(body):
            end = at + size
            cut = body.rfind(" ", at, end) + 1 if end < len(body) else len(body)
            end = cut if cut > at else end
            yield nth, body[at:end]
            at, nth = end, nth + 1


def register(spark: SparkSession) -> None:
    """Makes tidy_text, as_bool, as_int, as_bytes, distinct_fold and the table function text_parts known to the session's SQL."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.udtf.register("text_parts", TextParts)
