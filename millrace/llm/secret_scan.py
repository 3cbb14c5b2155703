"""Secrets in texts: patterns, and two Markov models of characters.

Base spans come from three patterns (assign, access, hex), leftmost and non-overlapping for each kind, with a least length for each.

Markov models: strings are runs of letters, digits and  + / _ -  of ``LEAST_CHARS`` or more, apart from base spans. One model holds how
characters follow one another in random strings, the other in ordinary identifiers. Both are trained from samples labelled
``secret`` or not, each distinct string once, so copies do not weigh; ``labelled`` takes the samples from the whole corpus: values that the
patterns found, and other runs of ``LEAST_WORD`` or more that have digits at their end only. A secret may be drawn from any alphabet, so
``UNIFORM`` of the mass of the first model is spread over all symbols. A run is a secret (kind ``random``) when its log-likelihood under the first
model exceeds that under the second by ``LEAST_RATIO`` in all and by ``LEAST_MEAN`` for each character.

All of it is DataFrame functions. The model is a table of 67 x 67 numbers, however large the corpus: symbols are counted by a grouping
that is combined inside the tasks. Offsets are running sums, linear in a text's length.

Null texts are empty and have no spans. Repeated rows get the same spans each. A corpus without samples of one of the labels has no
``random`` spans; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.pii import running

KINDS = ("assign", "access", "hex")
#: The patterns (quantifiers that never need to give back are possessive), and the least lengths: of an assigned value, of
#: an access key, of a hexadecimal run.
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+"
PATTERNS = {"assign": _KEYWORD + r"[A-Za-z0-9+/_.=-]++", "access": r"AKIA[A-Z0-9]++", "hex": r"[0-9a-f]{16,}+", "random": r"[A-Za-z0-9+/_-]{16,}+"}
_LEAST = {"assign": 12, "access": 18}
LEAST_CHARS = 16
LEAST_WORD = 8
LEAST_RATIO = 12.0
LEAST_MEAN = 0.6
#: Added to the count of every symbol, so that none is impossible; and how many steps from a symbol the symbols' own shares count for.
SMOOTHING = 0.5
BACKOFF = 5.0
#: The share of the model of secrets that is not learned.
UNIFORM = 0.5

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_SYMBOLS = len(ALPHABET) + 1  # the last one stands before a string
_SPANS = "array<struct<first:int,end:int,value:string>>"


def _value(found: Column) -> Column:
    """What an assignment assigns."""
    return F.regexp_replace(found, "^" + _KEYWORD, "")


def _at_least(n: int):
    return lambda x: F.char_length(x) >= n


def with_spans(rows: DataFrame, kinds: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns of ``rows`` and for each kind ``secret_<kind>``: its matches (first, end, value), in order, short ones left out."""
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    found, gaps, starts = ({k: f"secret_{k}_{x}" for k in kinds} for x in ("found", "gaps", "starts"))
    rows = rows.withColumns({found[k]: F.regexp_extract_all(whole, F.lit(PATTERNS[k]), F.lit(0)) for k in kinds})
    rows = rows.withColumns({gaps[k]: F.when(F.size(found[k]) > 0, F.split(whole, F.lit(PATTERNS[k]), -1)).otherwise(none) for k in kinds})

    def sizes(kind: str) -> Column:
        return F.transform(found[kind], lambda x, i: F.char_length(x) + F.char_length(F.get(gaps[kind], i)))

    rows = rows.withColumns({starts[k]: running(sizes(k), lambda a, x: a + x) for k in kinds})

    def spans(kind: str) -> Column:
        def make(value: Column, i: Column) -> Column:
            first = F.get(starts[kind], i) + F.char_length(F.get(gaps[kind], i))
            return F.struct(first.alias("first"), (first + F.char_length(value)).alias("end"), value.alias("value"))

        least = {"assign": lambda x: F.char_length(_value(x["value"])) >= _LEAST["assign"], "access": lambda x: F.char_length(x["value"]) >= _LEAST["access"]}
        return F.filter(F.transform(found[kind], make), least.get(kind, lambda x: F.lit(True)))

    rows = rows.withColumns({f"secret_{k}": F.when(F.size(found[k]) > 0, spans(k)).otherwise(F.array().cast(_SPANS)) for k in kinds})
    return rows.drop(*found.values(), *gaps.values(), *starts.values())


def labelled(docs: DataFrame) -> DataFrame:
    """The samples of the whole corpus, each distinct string once: string, secret.

    What the patterns find is secret: assigned values, access keys, hexadecimal runs with a letter (digits alone may count anything). Other
    runs of ``LEAST_WORD`` or more with a letter are ordinary identifiers, unless a digit stands before a letter: a secret that no pattern
    found would teach the wrong model.
    """
    texts = docs.select("text").where("text is not null")
    values = {k: F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)) for k in KINDS}
    values["assign"] = F.transform(values["assign"], _value)
    found = F.concat(*(F.filter(values[k], _at_least(_LEAST.get(k, 0))) for k in KINDS))
    hits = texts.select(F.explode(found).alias("found"))
    secrets = hits.select(F.explode(F.regexp_extract_all("found", F.lit("[A-Za-z0-9+/_-]{16,}+"), F.lit(0))).alias("string"), F.lit(True).alias("secret"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", PATTERNS["assign"], " "), "AKIA[A-Z0-9]{14,}+", " "), PATTERNS["hex"], " ")
    runs = texts.select(F.explode(F.regexp_extract_all(rest, F.lit(rf"[A-Za-z0-9+/_-]{{{LEAST_WORD},}}+"), F.lit(0))).alias("string"), F.lit(False).alias("secret"))
    runs = runs.where(~F.col("string").rlike("[0-9][^A-Za-z]*[A-Za-z]"))
    return secrets.unionByName(runs).where(F.col("string").rlike("[A-Za-z]")).distinct()


def _symbols(string: Column) -> Column:
    """The numbers of a string's characters."""
    return F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _steps(string: Column) -> Column:
    """Numbers of the steps from each character to the next, from the one before the string on."""
    codes = _symbols(string)
    before = F.concat(F.array(F.lit(_SYMBOLS - 1)), F.slice(codes, 1, F.char_length(string) - 1))
    return F.zip_with(before, codes, lambda a, b: a * _SYMBOLS + b)


def ratios(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float] | None:
    """log p(step | secret) - log p(step | ordinary) of each step of two symbols, from samples (string, secret); None if a label has none."""
    rows = samples.select("secret", F.explode(_steps(F.col("string"))).alias("step")).groupBy("secret", "step").count().collect()  # 2 * 67 * 67 at most
    counts = {(bool(r["secret"]), r["step"]): r["count"] for r in rows}
    if {s for s, _ in counts} != {True, False}:
        return None
    logs, every = {}, range(_SYMBOLS)
    for secret in (True, False):
        flat = UNIFORM if secret else 0.0
        symbols = [sum(counts.get((secret, a * _SYMBOLS + b), 0) for a in every) + smoothing for b in every]
        for a in every:
            row = [counts.get((secret, a * _SYMBOLS + b), 0) + BACKOFF * symbols[b] / sum(symbols) for b in every]
            for b in every:
                logs[secret, a * _SYMBOLS + b] = math.log((1 - flat) * row[b] / sum(row) + flat / _SYMBOLS)
    return [round(logs[True, k] - logs[False, k], 6) for k in range(_SYMBOLS**2)]


def ratio(string: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string."""
    table = F.from_json(F.lit("[" + ",".join(map(repr, model)) + "]"), "array<double>")  # folded into one constant
    return F.aggregate(_steps(string), F.lit(0.0), lambda a, k: a + F.get(table, k))


def _random(model: list[float]) -> Column:
    """The runs that the models take for secrets, without those that overlap a base span."""
    base = F.concat(*(F.col(f"secret_{k}") for k in KINDS))

    def holds(x: Column) -> Column:
        score = ratio(x["value"], model)
        least = F.greatest(F.lit(LEAST_RATIO), F.char_length(x["value"]) * LEAST_MEAN)
        free = ~F.exists(base, lambda y: (y["first"] < x["end"]) & (x["first"] < y["end"]))
        return free & x["value"].rlike("[A-Za-z]") & (score >= least)

    return F.filter("secret_random", holds)


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, secret_assign, secret_access, secret_hex, secret_random: spans (first, end, value) in code points."""
    if model is None:
        model = ratios(stored(labelled(docs), "samples"))
    rows = with_spans(docs.select("doc_id", "text"), (*KINDS, "random") if model else KINDS)
    random = _random(model) if model else F.array().cast(_SPANS)
    return rows.select("doc_id", *(f"secret_{k}" for k in KINDS), random.alias("secret_random"))


def _joined(kinds: tuple[str, ...]) -> Column:
    """All spans as kind:first:end, by first, then kind."""
    named = F.array(*(F.lit(k) for k in kinds))

    def numbered(i: int):
        return lambda x: F.struct(x["first"].alias("first"), F.lit(i).alias("kind"), x["end"].alias("end"))

    all_of = F.concat(*(F.transform(f"secret_{k}", numbered(i)) for i, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(all_of), lambda x: F.concat_ws(":", F.get(named, x["kind"]), x["first"], x["end"])), ",")


def find(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    return scan(docs, model).select(
        "doc_id",
        *(F.size(f"secret_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(KINDS), 256).alias("base_sha256"),
        _joined((*KINDS, "random")).alias("spans"),
        F.size("secret_random").cast("long").alias("n_random"),
    )
