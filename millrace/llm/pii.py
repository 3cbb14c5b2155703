"""Personal data: patterns, and terms that give a protected entity away.

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping for each kind, with the checks of each kind.

Information-theoretic sanitisation: the entities to protect are the values that the patterns found, and the groups that these belong to
(an address's domain and name, a network, a card issuer, a dialling area), since a single value is seldom seen twice. The context of an
entity is the words beside it: up to ``CONTEXT_WORDS`` on each side, within ``CONTEXT_CHARS``, on its line and before the next value of its kind. Equal contexts
count once. A term (blank-separated word) discloses an entity when  PMI(term; entity) >= ``DISCLOSURE`` * IC(entity),  that is when
    log2 p(term | entity) - log2 p(term) >= DISCLOSURE * -log2 p(entity),
with probabilities over the lines of the whole corpus, from ``LEAST_CONTEXTS`` different contexts in as many different texts at least: what
was seen in one context, or in copies of one, is no estimate. In every text that holds the entity, the term becomes a span of kind ``term`` wherever it stands as a word.
Redaction removes base spans to their kind in brackets, and generalises a term to ``[TERM]``.

All of it is DataFrame functions, and linear in the length of a text and its number of matches: offsets are running sums in blocks, texts
are cut by blocks of code points, and terms are found by a join of words. The corpus counts of terms are taken for candidate terms alone.
Null texts are empty and have no spans; repeated rows get the same spans each; an empty table gives no
rows; extra columns are kept by ``sanitize``.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that no start is tried twice: runs are entered at their beginning or where the last match
#: ended (\G), and quantifiers that never need to give back are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARDS = {"email": "@[A-Za-z0-9-]++\\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
DISCLOSURE = 0.75
LEAST_CONTEXTS = 2
CONTEXT_WORDS = 6
CONTEXT_CHARS = 120
#: Candidate terms up to so many are broadcast (some 20 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: So many pairs of text and term are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_PAIRS = 200_000
#: Entries of a block of running values, and code points of a block of text.
_BLOCK = 256
_TEXT_BLOCK = 4096

_SPAN = "array<struct<first:int,end:int>>"
_FOUND = "array<struct<first:int,end:int,value:string,words:array<string>>>"
_BLANK = r"[\x20\x09-\x0D]+"


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """What ``combine`` makes of all entries before each entry of an int array; blocks keep the copying linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)))
    empty = F.array().cast("array<int>")

    def along(entries: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), empty.alias("out"))
        return F.aggregate(entries, start, lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), combine))
    out = F.flatten(F.zip_with(blocks, along(totals, F.lit(zero)), along))
    return F.when(F.size(values) > 0, out).otherwise(empty)


def _text_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, first: Column, end: Column) -> Column:
    """Code points first to end of a text in blocks."""
    low = F.floor(first / _TEXT_BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, low + 1, F.floor(end / _TEXT_BLOCK).cast("int") - low + 1), "")
    return F.when(end > first, F.substring(some, first - low * _TEXT_BLOCK + 1, end - first)).otherwise("")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(digits))
    number = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(number(i) > 4, number(i) * 2 - 9).otherwise(number(i) * 2)
    return F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(i)).otherwise(number(i))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), F.lit(4)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.char_length(digits).between(16, 19) & F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def _beside(gap: Column, last: bool) -> Column:
    """The words of a gap next to its end (or its beginning), whole ones only."""
    if last:
        words = _words(F.substring_index(F.right(F.concat(F.lit(" "), gap), F.lit(CONTEXT_CHARS)), "\n", -1))
        whole = F.when((F.char_length(gap) >= CONTEXT_CHARS) & (F.size(words) > 0) & ~F.right(gap, F.lit(CONTEXT_CHARS)).contains("\n"), F.slice(words, 2, F.size(words))).otherwise(words)
        return F.reverse(F.slice(F.reverse(whole), 1, CONTEXT_WORDS))
    words = _words(F.substring_index(F.left(F.concat(gap, F.lit(" ")), F.lit(CONTEXT_CHARS)), "\n", 1))
    whole = F.when((F.char_length(gap) >= CONTEXT_CHARS) & (F.size(words) > 0) & ~F.left(gap, F.lit(CONTEXT_CHARS)).contains("\n"), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    return F.slice(whole, 1, CONTEXT_WORDS)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and, for each kind, a column ``pii_<kind>`` of its valid spans (first, end, value, words beside it), in order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = {k: f"pii_{k}_found" for k in KINDS}
    gaps = {k: f"pii_{k}_gaps" for k in KINDS}
    starts = {k: f"pii_{k}_starts" for k in KINDS}
    none = F.array().cast("array<string>")
    rows = docs.withColumns({found[k]: F.when(whole.rlike(_GUARDS[k]), F.regexp_extract_all(whole, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    rows = rows.withColumns({gaps[k]: F.when(F.size(found[k]) > 0, F.split(whole, F.lit(PATTERNS[k]), -1)).otherwise(none) for k in KINDS})

    def sizes(kind: str) -> Column:
        return F.transform(found[kind], lambda x, i: F.char_length(x) + F.char_length(F.get(gaps[kind], i)))

    rows = rows.withColumns({starts[k]: running(sizes(k), lambda a, x: a + x) for k in KINDS})

    def spans(kind: str) -> Column:
        def make(value: Column, i: Column) -> Column:
            gap = F.get(gaps[kind], i)
            first = F.get(starts[kind], i) + F.char_length(gap)
            words = F.concat(_beside(gap, True), _beside(F.get(gaps[kind], i + 1), False))
            return F.struct(first.alias("first"), (first + F.char_length(value)).alias("end"), value.alias("value"), words.alias("words"))

        return F.filter(F.transform(found[kind], make), lambda s: _valid(kind, s["value"]))

    rows = rows.withColumns({f"pii_{k}": F.when(F.size(found[k]) > 0, spans(k)).otherwise(F.array().cast(_FOUND)) for k in KINDS})
    return rows.drop(*found.values(), *gaps.values(), *starts.values())


def _entities(kind: str, value: Column) -> Column:
    """The names of what a value belongs to: itself, and its groups."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        name = F.regexp_replace(F.lower(F.substring_index(value, "@", 1)), "[^a-z]", "")
        names = [F.lower(value), F.concat(F.lit("@"), F.lower(F.substring_index(value, "@", -1))), F.when(F.char_length(name) >= 4, name)]
    elif kind == "ip":
        names = [value, F.substring_index(value, ".", 2)]
    else:
        names = [digits, F.left(digits, F.lit(6 if kind == "card" else 4))]
    return F.array_compact(F.transform(F.array(*names), lambda n: F.concat(F.lit(f"{kind} "), n)))


def _named(rows: DataFrame, *columns) -> DataFrame:
    """A row for each base span: ``columns``, entities, words."""

    def of(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda s: F.struct(_entities(kind, s["value"]).alias("entities"), s["words"].alias("words")))

    spans = F.concat(*map(of, KINDS))
    return rows.select(*columns, F.explode(spans).alias("s")).select("*", "s.entities", "s.words").drop("s")


def disclosing_terms(held: DataFrame, texts: DataFrame, disclosure: float = DISCLOSURE, least: int = LEAST_CONTEXTS) -> DataFrame | None:
    """entity, term of every disclosing pair, of the spans of ``held`` (with_base) in the corpus ``texts``; None where no pair has contexts enough."""
    seen = _named(held, F.xxhash64("text").alias("text_id")).select(F.explode("entities").alias("entity"), "text_id", F.xxhash64("words").alias("context"), F.array_distinct("words").alias("words"))
    seen = stored(seen, "contexts")
    many = seen.groupBy("entity").agg(F.countDistinct("context").alias("n_entity"))
    pairs = seen.select("entity", "text_id", "context", F.explode("words").alias("term"))
    beside = pairs.groupBy("term").agg(F.countDistinct("text_id").alias("n_beside"))  # no more than the lines that hold the term
    pairs = pairs.groupBy("entity", "term").agg(F.countDistinct("context").alias("n_pair"), F.countDistinct("text_id").alias("n_texts"))
    pairs = pairs.where((F.col("n_pair") >= least) & (F.col("n_texts") >= least)).join(many, "entity").join(beside, "term")
    n_lines = texts.agg(F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(1)).alias("n")).first().n

    def discloses(n_term: Column) -> Column:
        pmi = F.log2(F.col("n_pair") / F.col("n_entity")) - F.log2(n_term / F.lit(n_lines))
        return pmi >= disclosure * -F.log2(F.col("n_entity") / F.lit(n_lines))

    # Contexts count once, so a term can stand in more of them than in lines. Terms that are too common beside entities need no count.
    pairs = stored(pairs.where(discloses(F.greatest("n_beside", "n_pair"))).select("entity", "term", "n_pair", "n_entity"), "pairs")
    terms = stored(pairs.select("term").distinct(), "candidates")
    n_terms = terms.count()
    if not n_terms:
        return None
    size = F.broadcast if n_terms <= BROADCAST_ROWS else (lambda df: df)
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    counts = lines.select(F.explode(F.array_distinct(_words(F.col("line")))).alias("term")).join(size(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    joined = pairs.join(size(counts), "term")
    return stored(joined.where(discloses(F.greatest("n_term", "n_pair"))).select("entity", "term"), "disclosing")


def with_spans(docs: DataFrame, disclosure: float = DISCLOSURE, least: int = LEAST_CONTEXTS) -> DataFrame:
    """The columns of ``docs``, pii_<kind> for each kind, and pii_term."""
    # Only rows that hold a span are stored, so the patterns are matched again for the others: twice the matching, none of their texts on disk.
    any_span = sum(F.size(f"pii_{k}") for k in KINDS) > 0
    based = with_base(docs).select("*", F.explode(F.array(any_span)).alias("pii_any"))  # a generated column keeps filters above the spans
    held = stored(based.where("pii_any").drop("pii_any"), "held")
    others = based.where("not pii_any").drop("pii_any").withColumn("pii_term", F.array().cast(_SPAN))
    terms = disclosing_terms(held, docs.select("text").where("text is not null"), disclosure, least)
    if terms is None or not terms.take(1):
        return others.unionByName(held.withColumn("pii_term", F.array().cast(_SPAN)))
    # Each distinct text with entities gets their terms, and its words are joined with them.
    own = _named(held, F.sha2("text", 256).alias("pii_key")).select("pii_key", F.explode("entities").alias("entity")).distinct()
    chosen = stored(own.join(terms, "entity").select("pii_key", "term").distinct(), "chosen")
    texts = held.select(F.sha2("text", 256).alias("pii_key"), "text").join(chosen.select("pii_key").distinct(), "pii_key", "left_semi").dropDuplicates(["pii_key"])
    # A word and the blanks after it; blanks before the first word make an entry of their own.
    texts = texts.select("pii_key", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]*"), F.lit(0)).alias("parts"))
    texts = texts.withColumn("sizes", F.transform("parts", F.char_length)).withColumn("starts", running(F.col("sizes"), lambda a, x: a + x))
    placed = texts.select("pii_key", F.explode(F.arrays_zip("parts", "starts")).alias("p")).select("pii_key", F.regexp_replace("p.parts", _BLANK, "").alias("term"), F.col("p.starts").alias("first"))
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_PAIRS else chosen
    placed = placed.join(few, ["pii_key", "term"]).select("pii_key", F.struct("first", (F.col("first") + F.char_length("term")).alias("end")).alias("span"))
    spans = stored(placed.groupBy("pii_key").agg(F.array_sort(F.collect_list("span")).cast(_SPAN).alias("pii_term")), "terms")  # of one text
    with_terms = held.withColumn("pii_key", F.sha2("text", 256)).join(spans, "pii_key", "left").drop("pii_key")
    return others.unionByName(with_terms.withColumn("pii_term", F.coalesce("pii_term", F.array().cast(_SPAN))))


def _labelled(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["first"], s["end"]))


def find(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = with_spans(docs.select("doc_id", "text"), **options)
    base = F.concat(*(_labelled(k, F.col(f"pii_{k}")) for k in KINDS))
    return rows.select(
        "doc_id",
        *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _labelled("term", F.col("pii_term"))), ",").alias("spans"),
        F.size("pii_term").cast("long").alias("n_term"),
    )


def redacted(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``rows`` with each span of text replaced by its kind in brackets; overlapping spans become one, named by the first (of one start, the longest)."""

    def tagged(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda x: F.struct(x["first"].alias("first"), (-x["end"]).alias("longest_first"), F.lit(f"[{kind.upper()}]").alias("tag")))

    rows = rows.withColumn("pii_all", F.array_sort(F.concat(*map(tagged, kinds))))
    rows = rows.withColumn("pii_blocks", F.when(F.size("pii_all") > 0, _text_blocks(F.col("text"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("pii_before", running(F.transform("pii_all", lambda s: -s["longest_first"]), lambda a, x: F.greatest(a, x)))  # where the spans before end
    parts = F.zip_with("pii_all", "pii_before", lambda s, at: F.when(s["first"] >= at, F.concat(_cut(F.col("pii_blocks"), at, s["first"]), s["tag"])))
    end = F.aggregate("pii_all", F.lit(0), lambda a, s: F.greatest(a, -s["longest_first"]))
    text = F.concat(F.array_join(F.array_compact(parts), ""), _cut(F.col("pii_blocks"), end, F.char_length("text")))
    return rows.withColumn("text", F.when(F.size("pii_all") > 0, text).otherwise(F.col("text"))).drop("pii_all", "pii_blocks", "pii_before")


def sanitize(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all spans of its texts redacted; n_chars, where there is one, follows the text, other columns are as they were."""
    clash = {c: f"_own_{c}" for c in docs.columns if c.startswith("pii_")}
    rows = redacted(with_spans(docs.withColumnsRenamed(clash), **options), (*KINDS, "term"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    out = rows.select(*(clash.get(c, c) for c in docs.columns))
    return out.withColumnsRenamed({v: k for k, v in clash.items()})
