"""Divergence of sources: how each source of a language uses its terms, against each other source and against the language.

A term is a run of letters (A-Z lower-cased, all beyond ASCII kept as it is). A language keeps the terms in at least ``LEAST_DOCS`` of its
documents (V of them). Every (language, source) group, and the language, gives each kept term  p = 1 + floor(10^9 (count + 1) / (N + V)).
The divergence of p from q at a term is  floor((p - q)^2 / q).

Late materialization of strings:

1. Texts become term counts in NumPy batches: a term is a 64-bit digest, and only (language, source, digest, count, documents) leaves a
   task, already added up. These are dealt by digest and language, where the kept ones show without another shuffle.
2. A second reading gives each kept digest its least string, and how many it has. Where these are several, different terms share the
   digest: these, and no others, are counted again by their strings (``split``), each a term of its own.
3. Pairs of sources: the sum over all kept terms is one over the histogram of a group's counts, as if no term were in both groups, and a
   correction for the terms that are. The corrections stream by term, sorted, and are added up by pair inside the tasks.
4. Terms of a group are ranked by value with ties (a partial top-k in each task); strings are joined to the survivors alone, which order
   the ties.

All arithmetic is in whole numbers. Null text, lang and source are ''. Repeated rows are documents of their own. An empty table gives no
rows; other columns are ignored, whatever their names. Value sums are longs; p needs N + V below 10^27.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SUMMED_BYTES, Roller, Words, small_batches, stored, text_chunks, tidy, utf8

LEAST_DOCS = 3
SHARE = 1_000_000_000
#: Counts below this, times SHARE, are longs.
SHORT = 9_000_000_000
TERM_RANKS = 200
#: Counts that a task holds before it hands them on; strings that it remembers having told.
HELD = 400_000
#: Parts that the rows of a language are dealt to where its groups meet.
SALTS = 32

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_ALL_BITS = 64


def _terms(column: pa.Array, roller: Roller, bits: int) -> tuple[np.ndarray, Words, np.ndarray]:
    data, offsets = utf8(column)
    words = Words(data, offsets, _OUTSIDE)
    digests = roller.ranges(roller.prefix(data), words.start, words.end) >> np.uint64(_ALL_BITS - bits)
    return data, words, digests.view(np.int64)


def _summed(group: np.ndarray, digest: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of values by group and digest."""
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])]) if len(group) else np.zeros(0, np.int64)
    return group[new], digest[new], *(np.add.reduceat(v[order], new) if len(new) else v for v in values)


def _count(bits: int):
    @tidy
    def run(batches):
        roller, codes, parts, held = Roller(12, fold=True), {}, [], 0

        def flush():
            group, digest, count, docs = _summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            names = list(codes)
            columns = [pa.array([names[g][i] for g in group.tolist()], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in (digest, count, docs))], names=["lang", "source", "digest", "count", "docs"])

        for cut in text_chunks(batches, limit=SUMMED_BYTES):
            keys = zip(pc.fill_null(cut.column("lang"), "").to_pylist(), pc.fill_null(cut.column("source"), "").to_pylist(), strict=True)
            group = np.array([codes.setdefault(k, len(codes)) for k in keys], np.int64)
            _, words, digests = _terms(cut.column("text"), roller, bits)
            doc, digest, count = _summed(words.doc, digests, np.ones(len(digests), np.int64))
            parts.append(_summed(group[doc], digest, count, np.ones(len(doc), np.int64)))
            held += len(parts[-1][0])
            if held > HELD:
                parts[:] = [_summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield flush()
                    parts.clear()
                    codes.clear()
                    held = 0
        if parts:
            yield flush()

    return run


def _strings(data: np.ndarray, words: Words) -> pa.LargeStringArray:
    """The words, A-Z lower-cased, one string each."""
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_UPPER[data[words.inside]])))


def _tell(bits: int):
    """Every digest with its string, once a task as far as it remembers."""

    @tidy
    def run(batches):
        roller, told = Roller(12, fold=True), set()
        for cut in text_chunks(batches, limit=SUMMED_BYTES):
            data, words, digests = _terms(cut.column("text"), roller, bits)
            coded = _strings(data, words).dictionary_encode()
            place = np.zeros(len(coded.dictionary), np.int64)
            place[coded.indices.to_numpy(zero_copy_only=False)] = np.arange(len(digests))
            if len(told) > HELD:
                told.clear()
            new = [(s, d) for s, d in zip(coded.dictionary.to_pylist(), digests[place].tolist(), strict=True) if s not in told]
            told.update(s for s, _ in new)
            yield pa.RecordBatch.from_arrays([pa.array([d for _, d in new], pa.int64()), pa.array([s for s, _ in new], pa.string())], names=["digest", "term"])

    return run


def _spell(bits: int):
    """The counts of a cut by string: lang, source, digest, split, count, docs."""

    @tidy
    def run(batches):
        roller = Roller(12, fold=True)
        for cut in text_chunks(batches, limit=SUMMED_BYTES):
            data, words, digests = _terms(cut.column("text"), roller, bits)
            coded = _strings(data, words).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.zeros(len(coded.dictionary), np.int64)
            place[codes] = np.arange(len(digests))
            doc, code, count = _summed(words.doc, codes, np.ones(len(codes), np.int64))
            rows = pa.array(doc)
            columns = [pc.fill_null(cut.column(c), "").take(rows) for c in ("lang", "source")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests[place[code]]), coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(count), pa.array(np.ones(len(doc), np.int64))], names=["lang", "source", "digest", "split", "count", "docs"])

    return run


def _kept(counts: DataFrame) -> DataFrame:
    """The counts of each language's kept terms, with the term's count in the language; ``first`` marks one row of each term."""
    term = Window.partitionBy("digest", "lang", "split")
    rows = counts.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_count", F.sum("count").over(term)).withColumn("first", F.col("source") == F.min("source").over(term))
    return rows.where(F.col("lang_docs") >= LEAST_DOCS).select("lang", "source", "digest", "split", "count", "lang_count", "first")


def _counted(texts: DataFrame, bits: int) -> DataFrame:
    """The rows of kept digests. Tasks have added up what they can, so rows are dealt by term at once, and all sums of a term follow there."""
    rows = texts.mapInArrow(_count(bits), "lang string, source string, digest long, count long, docs long").repartition("digest", "lang")
    return _kept(rows.groupBy("lang", "source", "digest").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).withColumn("split", F.lit("")))


def _spelled(texts: DataFrame, bits: int) -> DataFrame:
    """Each digest with its least string and how many it has (term, strings). Strings become distinct by hashing first: the least is found by sorting."""
    told = texts.select("text").mapInArrow(_tell(bits), "digest long, term string").repartition("digest").distinct()
    return told.groupBy("digest").agg(F.min("term").alias("term"), F.count("*").alias("strings"))


def term_counts(docs: DataFrame, bits: int = _ALL_BITS) -> tuple[DataFrame, DataFrame]:
    """Kept counts (lang, source, digest, split, count, lang_count, first), and a dictionary (digest, split, term) of terms that a language keeps.

    ``split`` is '' where all strings of a digest are one, and the string where they are not. Fewer ``bits`` make such digests likelier.
    """
    texts = small_batches(docs.select("text", "lang", "source"))
    held = stored(_counted(texts, bits), "counts")
    kept = held.where("first").select("digest").distinct()
    words = stored(_spelled(texts, bits).join(kept, "digest", "left_semi"), "words")
    shared = words.where("strings > 1").select("digest")
    if shared.isEmpty():
        return held, words.select("digest", F.lit("").alias("split"), "term")
    again = texts.mapInArrow(_spell(bits), "lang string, source string, digest long, split string, count long, docs long").join(shared, "digest", "left_semi")
    again = stored(_kept(again.groupBy("lang", "source", "digest", "split").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))), "split")
    held = held.join(shared, "digest", "left_anti").select(again.columns).unionByName(again)
    words = words.where("strings = 1").select("digest", F.lit("").alias("split"), "term").unionByName(again.select("digest", "split", F.col("split").alias("term")).distinct())
    return held, words


def _probability(count, total) -> Column:
    """1 + floor(10^9 (count + 1) / total), exact for any longs."""
    wide = "decimal(19,0)"
    share = F.call_function("div", F.lit(SHARE).cast("decimal(10,0)") * (count + 1).cast(wide), total.cast(wide))
    share = F.when(count < SHORT, F.call_function("div", F.lit(SHARE).cast("long") * (count.cast("long") + 1), total.cast("long"))).otherwise(share)
    return F.when(total > 0, 1 + share).otherwise(F.lit(None).cast("long"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _overlaps(batches):
    """Sorted by term: the corrections of every pair of groups at the terms that both hold, added up by pair."""
    sums: dict[tuple[str, str, str], int] = {}

    def add(table: pa.Table) -> None:
        coded = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source", "split")]
        names, sources = coded[0].dictionary.to_pylist(), coded[1].dictionary.to_pylist()
        lang, source, split = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded)
        digest, p, q = (table.column(c).to_numpy() for c in ("digest", "p", "base"))
        group = lang * len(sources) + source
        new = np.r_[True, (lang[1:] != lang[:-1]) | (digest[1:] != digest[:-1]) | (split[1:] != split[:-1])]
        term = np.cumsum(new)
        for step in range(1, len(term)):
            at = np.flatnonzero(term[step:] == term[:-step])
            if not len(at):
                break
            a, b = at, at + step
            both = _apart(q[a], q[b]), _apart(q[b], q[a])
            one = _apart(p[a], p[b]) - _apart(p[a], q[b]) - _apart(q[a], p[b]) + both[0]
            other = _apart(p[b], p[a]) - _apart(p[b], q[a]) - _apart(q[b], p[a]) + both[1]
            pair = np.concatenate([group[a] * (len(names) * len(sources)) + group[b], group[b] * (len(names) * len(sources)) + group[a]])
            found, _, value = _summed(pair, np.zeros_like(pair), np.concatenate([one, other]))
            for k, v in zip(found.tolist(), value.tolist(), strict=True):
                first, second = divmod(k, len(names) * len(sources))
                key = (names[first // len(sources)], sources[first % len(sources)], sources[second % len(sources)])
                sums[key] = sums.get(key, 0) + v

    def flush():
        rows = list(zip(*((*k, v) for k, v in sums.items()), strict=True)) if sums else [()] * 4
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])

    held = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < HELD // 2:
            continue
        table = pa.Table.from_batches(held)
        last = table.slice(table.num_rows - 1)
        same = pc.and_(pc.equal(table["lang"], last["lang"][0]), pc.and_(pc.equal(table["digest"], last["digest"][0]), pc.equal(table["split"], last["split"][0])))
        whole = table.num_rows - pc.sum(same).as_py()  # the last term may go on
        if whole:
            add(table.slice(0, whole))
        held = table.slice(whole).to_batches()
        if len(sums) > HELD:
            yield flush()
    if sum(x.num_rows for x in held):
        add(pa.Table.from_batches(held))
    yield flush()


def audit(docs: DataFrame, bits: int = _ALL_BITS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    held, words = term_counts(docs, bits)
    sizes = stored(held.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("distinct"), F.count_if("first").alias("firsts")), "sizes")
    languages = sizes.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
    sizes = sizes.drop("firsts")
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(languages, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total", "distinct"])
    groups = groups.withColumn("base", _probability(F.lit(0), F.col("total") + F.col("terms")))
    groups = stored(groups, "groups")
    scored = held.join(groups, ["lang", "source"])
    p = _probability(F.col("count"), F.col("total") + F.col("terms"))
    scored = stored(scored.select("lang", "source", "digest", "split", "count", p.alias("p"), "base", _probability(F.col("lang_count"), F.col("lang_total") + F.col("terms")).alias("q")), "scored")

    # A group's terms by their share, and those that it does not hold.
    shares = scored.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("n")).withColumn("holds", F.lit(True))
    shares = shares.unionByName(groups.select("lang", "source", F.col("base").alias("p"), "base", (F.col("terms") - F.col("distinct")).alias("n"), F.lit(False).alias("holds")))
    shares = shares.withColumn("salt", F.pmod(F.xxhash64("source", "p", "holds"), F.lit(SALTS)))
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = shares.join(others, ["lang", "salt"]).where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * F.coalesce(_divergence(F.col("p"), F.col("other")), F.lit(0))).alias("value"),
        F.sum(F.when(F.col("holds"), F.col("n") * (_divergence(F.col("other"), F.col("p")) - _divergence(F.col("other"), F.col("base")))).otherwise(0)).alias("back"),
    )
    met = met.select(F.explode(F.array(F.struct("lang", "source", "item", "value"), F.struct("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("r")).select("r.*")
    by_term = scored.repartition("digest", "lang", "split").sortWithinPartitions("digest", "lang", "split").select("lang", "source", "digest", "split", "p", "base")
    shared = by_term.mapInArrow(_overlaps, "lang string, source string, item string, value long")
    pairs = met.unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    terms = scored.where("p > q").select("lang", "source", "digest", "split", _divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("place", F.rank().over(group)).where(F.col("place") <= TERM_RANKS)
    terms = terms.join(words, ["digest", "split"]).select("lang", "source", F.col("term").alias("item"), "value")
    rows = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rows = rows.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TERM_RANKS))
    return rows.select("lang", "source", "part", "item", "value", "rank")
