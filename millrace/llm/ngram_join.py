"""N-gram Jaccard join: which documents share most of their word n-grams, and the groups that these links make.

The document-by-n-gram incidence matrix is multiplied with its transpose in blocks, and only where a product can reach the threshold:

1. Each whole text becomes its set of n-gram hashes. Equal sets are one node (a fingerprint), so exact copies never meet each other.
2. Columns are ordered by the frequency class of their rarest word (from a count sketch of fixed size over the words of the corpus, summed from
   one array a task), within a class the longest first, since long n-grams are rare, then by hash. Two sets with Jaccard >= t share ``depth`` columns (or all they must
   share) among the first n - ceil(t n) + depth of each, so only those entries are multiplied; a set's depth grows with its size.
   Frequent n-grams come last and are hardly ever among them.
3. A column with two nodes or more of like size is a block. Blocks of at most ``SMALL`` nodes give their pairs, whose overlap counts are
   accumulated; pairs with fewer than ``depth`` are discarded, unless they meet in a large block. Large blocks are tiles; in a tile, pairs
   whose sizes, or whose bitmaps, bound the overlap below the threshold are discarded. What is left is verified on the whole sets.
   A block of more than ``TILE`` nodes is first dealt anew: each of its sets meets one of them, its hub, and is told by what one of the two has
   and the other lacks. What all near copies share is gone from that. Two sets of which one does not link with the hub can link only if
   they differ from it in common columns, so many that one is among the first of both (``delta_prefix``). A set gives as many entries as
   before, whatever the size of its block. A block that is still too large is dealt anew ``LEVELS`` times, then cut to several tiles.
4. Links merge nodes to groups. First each node tries the partner (in large blocks, of the blocks' first nodes) with which it shares most
   columns; then every tile gives a spanning forest of pairs
   between its groups, of which each group tries its ``TRIES`` best, while that merges any. These rounds verify a number of pairs in
   proportion to the nodes. At last every pair between different groups that has not been tried is tried. A pair within a group can
   change no group, so all groups are exact, and no group emits all its pairs.

Null and empty texts have no n-grams and link with nothing, nor do rows with a null doc_id (component_id null). Repeated rows are copies.
An empty table gives no rows; extra columns are kept by ``keep`` and ignored otherwise. Sets are named by 64-bit fingerprints.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Roller, Words, mix, shingles, small_batches, stored, text_chunks, tidy, utf8
from millrace.llm.graph import components, merged

#: Counters of the sketch of word frequencies (2 MB a task) and how it is cut for adding up.
SKETCH = 1 << 19
SKETCH_PARTS = 32
#: Nodes of a tile; a block with more is dealt anew by differences from a hub, so many times at most, and then cut.
TILE = 1000
LEVELS = 3
#: Of the nodes that meet a hub, one in so many must differ from it in a column for that to be ordered by its number of nodes.
COMMON = 64
#: Blocks of so many nodes give all their pairs; larger ones are worked on as tiles.
SMALL = 64
#: n-grams of a set for one more column that its partners must share among the first ones.
DEPTH_STEP = 32
#: Pairs that a group tries in one round, and rounds before the last one, which tries whatever is left.
TRIES = 2
ROUNDS = 4
#: Bytes at most of a node's bitmap in a tile, and of the one that pairs are compared by before the last round.
TILE_BYTES = 512
BITMAP_BYTES = 4096
#: Tables of ids up to so many rows are broadcast (8 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_ROLLER = Roller(41, fold=True)
_U = np.uint64


class Sets:
    """The sorted distinct n-gram hashes of each text of a cut; for each n-gram the bytes of its words (255 at most) and where it begins."""

    def __init__(self, column: pa.Array, size: int):
        data, offsets = utf8(column)
        words = Words(data, offsets)
        self.size, self.words = size, _ROLLER.ranges(_ROLLER.prefix(data), words.start, words.end)
        keys, at = shingles(self.words, words.first, size)
        each = np.diff(at)
        first = np.arange(len(keys)) - np.repeat(at[:-1], each) + np.repeat(words.first[:-1], each)
        end = np.minimum(first + size, np.repeat(words.first[1:], each))
        total = np.concatenate([[0], np.cumsum(words.end - words.start)])
        spans = np.minimum(total[end] - total[first], 255).astype(np.uint8)
        self.keys, self.spans, self.ranges, self.counted = [], [], [], np.diff(words.first)
        self.first = words.first
        for a, b in zip(at[:-1], at[1:], strict=True):
            distinct, where = np.unique(keys[a:b], return_index=True)
            self.keys.append(distinct)
            self.spans.append(spans[a:b][where])
            self.ranges.append((first[a:b][where], end[a:b][where]))

    def rarest(self, i: int, ranks: np.ndarray) -> np.ndarray:
        """The least rank of the words of each n-gram of text i."""
        first, end = self.ranges[i]
        out = ranks[first]
        for j in range(1, self.size):
            out = np.minimum(out, ranks[np.minimum(first + j, end - 1)])
        return out


def fingerprint(keys: np.ndarray) -> int:
    return int(mix(np.array([mix(keys ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(keys))]))[0].astype(np.int64))


def least_common(n: int, percent: int) -> int:
    """The fewest n-grams that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def depth(n: int, percent: int) -> int:
    """How many shared columns are asked for among the first ones of a set of n."""
    return min(1 + n // DEPTH_STEP, least_common(n, percent))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least_common(n, percent) + depth(n, percent))


def _nodes(size: int):
    """doc_id, text_id, n, node of each document; then the task's sketch in parts (doc_id null)."""
    columns = ["doc_id", "text_id", "n", "node", "part", "counts"]

    @tidy
    def run(batches):
        sketch, seen = np.zeros(SKETCH, np.int64), set()
        for cut in text_chunks(batches):
            sets = Sets(cut.column("text"), size)
            names = [fingerprint(s) for s in sets.keys]
            new = np.zeros(cut.num_rows, bool)
            for i, name in enumerate(names):  # copies in one task count once
                new[i] = name not in seen
                seen.add(name)
            every = sets.words[np.repeat(new, sets.counted)]
            sketch += np.bincount((every & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            n = cut.num_rows
            own = [pa.array([len(s) for s in sets.keys], pa.int64()), pa.array(names, pa.int64())]
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("text_id"), *own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=columns)
        counts = np.minimum(sketch, 2**32 - 1).astype("<u4").reshape(SKETCH_PARTS, -1)
        rows = [c.tobytes() for c in counts]
        yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_PARTS, pa.int64())] * 4 + [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(rows, pa.binary())], names=columns)

    return run


def _add_up(key, batches):
    total = np.zeros(SKETCH // SKETCH_PARTS, np.int64)
    for b in batches:
        for x in b.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<u4")
    ranks = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], names=["part", "ranks"])


def _sketch(rows: DataFrame) -> np.ndarray:
    from collections.abc import Iterator

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _add_up(key, batches)

    parts = {r.part: np.frombuffer(r.ranks, np.uint8) for r in rows.groupBy("part").applyInArrow(add_up, "part int, ranks binary").collect()}
    return np.concatenate([parts.get(i, np.zeros(SKETCH // SKETCH_PARTS, np.uint8)) for i in range(SKETCH_PARTS)])


def _prefixes(size: int, percent: int, ranks):
    @tidy
    def run(batches):
        rank, seen = np.frombuffer(ranks.value, np.uint8), set()
        for cut in text_chunks(batches):
            keys, nodes, sizes = [], [], []
            sets = Sets(cut.column("text"), size)
            ranked = rank[(sets.words & _U(SKETCH - 1)).astype(np.int64)]
            for i, s in enumerate(sets.keys):
                if not len(s) or (node := fingerprint(s)) in seen:
                    continue
                seen.add(node)  # copies in one task count once
                k = prefix_length(len(s), percent)
                order = np.lexsort((s, 255 - sets.spans[i], sets.rarest(i, ranked)))[:k]
                keys.append(s[order])
                nodes.append(np.full(k, node))
                sizes.append(np.full(k, len(s), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["key", "node", "n"])

    return run


def delta_prefix(n: int, hub: int, delta: int, percent: int) -> int:
    """How many of the first ``delta`` columns in which a set of n differs from a hub of ``hub`` columns tell all its links but those within the hub's.

    Sets of n and m link if they differ in (100 - percent) / (100 + percent) * (n + m) columns at most. Where they differ from the hub in d
    and e columns, of which they have c in common, they differ in d + e - 2 c. If the other one does not link with the hub, so that its e is
    above that share of (m + hub), c is above (d + share * (hub - n)) / 2. If it links and this one does not, c is at least
    d - (100 - percent) / percent * n, since e >= c and m <= 100 / percent * n, and at least 1. Two that link with the hub are in its group.
    """
    near, far = 100 - percent, 100 + percent
    common = (delta * far + near * (hub - n)) // (2 * far) + 1
    if delta * far > near * (n + hub):  # not linked with the hub
        common = min(common, max(1, delta - near * n // percent))
    return max(0, delta - common + 1)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The n-grams that one of two sets has and the other lacks, ascending."""
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    out = np.ones(len(both), bool)
    out[1:][twice] = False
    out[:-1][twice] = False
    return both[out]


def _differences(batches):
    """For (hub, x: its n-grams, y: a node's) how many nodes of the batch differ from the hub in each n-gram."""
    for b in batches:
        met: dict[int, list] = {}
        for hub, x, y in zip(b.column("hub").to_pylist(), b.column("x"), b.column("y"), strict=True):
            met.setdefault(hub, []).append(differing(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
        for hub, found in met.items():
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), hub)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["hub", "key", "nodes"])


def _deltas(percent: int):
    """For (hub, node, x: the hub's n-grams, y: the node's, common: those in which many differ from the hub, the rarest first) the first of the
    node's differences, and a row without key where the two link."""

    @tidy
    def run(batches):
        last, common, order = None, None, None
        for b in batches:
            for hub, node, x, y, often in zip(b.column("hub").to_pylist(), b.column("node").to_pylist(), b.column("x"), b.column("y"), b.column("common"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if hub != last:
                    often = often.values.to_numpy().view(np.uint64) if often.is_valid else np.zeros(0, np.uint64)
                    last, order = hub, np.argsort(often, kind="stable")
                    common = often[order]
                keys = differing(x, y)
                linked = hub != node and len(keys) * (100 + percent) <= (100 - percent) * (len(x) + len(y))
                at = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
                place = np.where(common[at] == keys, order[at], -1) if len(common) else np.zeros(len(keys))
                keys = keys[np.lexsort((keys, place))][: delta_prefix(len(y), len(x), len(keys), percent)]
                names = mix(keys ^ mix(np.array([hub]).astype(np.uint64))).view(np.int64)
                k = len(names) + linked
                key = pa.concat_arrays([pa.array(names), pa.nulls(int(linked), pa.int64())])
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(k, hub)), pa.array(np.full(k, node)), pa.array(np.full(k, len(y), np.int32))], names=["key", "hub", "node", "n"])

    return run


def bitmap(keys: np.ndarray, most: int) -> bytes:
    """8 to 16 bits for every n-gram, as far as ``most`` bytes go."""
    bits = min(8 * most, max(64, 8 << (len(keys) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(keys & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _whole_sets(size: int):
    @tidy
    def run(batches):
        for cut in text_chunks(batches):
            sets = [s for s in Sets(cut.column("text"), size).keys if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "keys"])

    return run


def _bitmaps(size: int, most: int):
    @tidy
    def run(batches):
        for cut in text_chunks(batches):
            sets = [s for s in Sets(cut.column("text"), size).keys if len(s)]
            columns = [pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([bitmap(s, most) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "bitmap", "n"])

    return run


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap brought to ``width`` bytes (a divisor of its own length, a multiple of 8)."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).view(np.uint64)


def bounds(n, x: np.ndarray, m, y: np.ndarray):
    """The most n-grams that sets of n and m can share by their bitmaps (of one width): a bit that only one has counts one out."""
    common = np.bitwise_count(x & y).sum(-1, dtype=np.int64)
    return np.minimum(n - np.bitwise_count(x).sum(-1, dtype=np.int64) + common, m - np.bitwise_count(y).sum(-1, dtype=np.int64) + common)


def reachable(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether two sets of n and m n-grams with bitmaps x and y can have enough in common."""
    width = min(len(x), len(y))
    bound = int(bounds(n, folded(x, width), m, folded(y, width)))
    return 100 * bound >= percent * (n + m - bound)


def _reachable(percent: int):
    @tidy
    def run(batches):
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("n", "x", "m", "y"))
            keep = [reachable(n, x, m, y, percent) for n, x, m, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pairs_of_tile(key: int, rows: list[tuple], percent: int, forest: bool):
    """Pairs between groups of one tile that can reach the threshold, as (node, node, group, group, estimate in percent of a percent).

    Rows are (n, node, group, side, bitmap, keys), of sides 0 and 1 (or 0 alone). Each pair belongs to the block of its smallest common
    key alone. With ``forest`` a spanning forest of the groups by those pairs.
    """
    rows = sorted(rows, key=lambda r: r[:2])
    _, comp = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)
    if len(rows) < 2 or not comp.any():
        return
    n = np.array([r[0] for r in rows], np.int64)
    side = np.array([r[3] for r in rows], np.int64)
    cross = bool(side.any() and not side.all())
    width = np.array([len(r[4]) for r in rows])
    keys = [set(r[5]) for r in rows]
    bits: dict[int, tuple[int, np.ndarray]] = {}
    for w in np.unique(width).tolist():  # sizes ascend, so widths do
        first = int(np.searchsorted(width, w))
        bits[w] = first, np.stack([folded(r[4], w) for r in rows[first:]])
    for i in range(len(rows) - 1):
        last = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
        open_ = comp[i + 1 : last] != comp[i]
        if cross:
            open_ &= side[i + 1 : last] != side[i]
        others = i + 1 + np.flatnonzero(open_)
        if not len(others):
            continue
        first, matrix = bits[int(width[i])]
        most = bounds(n[i], matrix[i - first], n[others], matrix[others - first])
        good = 100 * most >= percent * (n[i] + n[others] - most)
        for j, bound in zip(others[good].tolist(), most[good].tolist(), strict=True):
            if forest and comp[j] == comp[i]:
                continue
            if min(keys[i] & keys[j], default=None) != key:
                continue
            if forest:
                comp[comp == comp[j]] = comp[i]
            x, y = sorted((rows[i][1:3], rows[j][1:3]))
            yield x[0], y[0], x[1], y[1], 10_000 * bound // int(n[i] + n[j] - bound)


def _tiles(percent: int, forest: bool):
    """Streams sorted tiles; holds one."""
    names = ["a", "b", "la", "lb", "estimate", "key", "low", "high"]

    @tidy
    def run(batches):
        current, rows, out = (None, None, None), [], []

        def flush():
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            out.clear()
            return batch

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("key", "low", "high", "n", "node", "grp", "side", "bitmap", "keys")]
            for key, low, high, *row in zip(*columns, strict=True):
                if (key, low, high) != current:
                    for pair in _pairs_of_tile(current[0], rows, percent, forest):
                        out.append((*pair, *current))
                        if len(out) > 10_000:
                            yield flush()
                    current, rows = (key, low, high), []
                rows.append(tuple(row))
        for pair in _pairs_of_tile(current[0], rows, percent, forest):
            out.append((*pair, *current))
            if len(out) > 10_000:
                yield flush()
        yield flush()

    return run


def _verify(percent: int):
    @tidy
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _best(pairs: DataFrame, a: str, b: str, by: str, most: int) -> DataFrame:
    """Of pairs (a, b and what names their ends), those among the ``most`` best of either end."""
    ends = pairs.select(F.col(a).alias("end"), "a", "b", by).union(pairs.select(F.col(b).alias("end"), "a", "b", by))
    nth = F.row_number().over(Window.partitionBy("end").orderBy(F.desc(by), F.xxhash64("a", "b")))
    return ends.withColumn("nth", nth).where(F.col("nth") <= most).select("a", "b").distinct()


def groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_id, n (set size), label (names its group)."""
    spark = docs.sparkSession
    texts = small_batches(docs).select("doc_id", "text")
    first = stored(texts.withColumn("text_id", F.xxhash64("text")).mapInArrow(_nodes(size), "doc_id long, text_id long, n long, node long, part int, counts binary"), "nodes")
    nodes = first.where(F.col("part").isNull()).select("doc_id", "text_id", "n", "node")
    ranks = spark.sparkContext.broadcast(_sketch(first.where(F.col("part").isNotNull()).select("part", "counts")).tobytes())

    entries = texts.where(F.col("doc_id").isNotNull()).mapInArrow(_prefixes(size, percent, ranks), "key long, node long, n int").repartition("key")
    entries = entries.groupBy("key", "node").agg(F.first("n").alias("n"))

    def blocks(entries: DataFrame) -> DataFrame:
        """The entries (key, node, n) that meet one of like size, with m, the nodes of their block."""
        by_size, block = Window.partitionBy("key").orderBy("n", "node"), Window.partitionBy("key")
        near = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
        return stored(entries.withColumn("near", near).where("near").select("key", "node", "n").withColumn("m", F.count("*").over(block)), "postings")

    postings = blocks(entries)
    located = nodes.where(F.col("doc_id").isNotNull())
    repeats = bool(located.groupBy("doc_id").count().where("count > 1").take(1))

    def of_texts(wanted: DataFrame, run, schema: str, name: str) -> DataFrame:
        """A row of ``run`` for each wanted node, from one text of each."""
        where = stored(located.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "where")
        some = texts.join(F.broadcast(where) if where.count() <= BROADCAST_ROWS else where, "doc_id", "left_semi")
        rows = some.mapInArrow(run, schema).join(wanted, "node", "left_semi")
        return stored(rows.dropDuplicates(["node"]) if repeats else rows, name)

    # Small blocks: pairs with their counts of shared columns.
    members = postings.where(F.col("m") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("nodes"))  # SMALL of them at most
    beside = F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    close = members.select(F.explode(F.filter(beside, lambda p: 100 * p["x"]["n"] >= percent * p["y"]["n"])).alias("p"))
    close = close.select(F.least("p.x.node", "p.y.node").alias("a"), F.greatest("p.x.node", "p.y.node").alias("b"), F.col("p.x.n").alias("n"))  # n: of the smaller set
    close = close.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("n").alias("n"))
    asked = F.least(1 + F.floor(F.col("n") / DEPTH_STEP), F.ceil(F.lit(percent) * F.col("n") / 100))
    close = stored(close.where(F.col("shared") >= asked).select("a", "b", "shared"), "close")

    # Blocks of more than a tile: entries by differences from a hub, and which nodes link with theirs.
    def dealt_anew(big: DataFrame) -> DataFrame:
        often = Window.partitionBy("node")
        counted = big.withColumn("blocks", F.count("*").over(often))  # a hub of many blocks, so that a node meets few
        hub_of = counted.groupBy("key").agg(F.max(F.struct("blocks", F.xxhash64("node"), "node"))["node"].alias("hub"))
        met = stored(big.join(hub_of, "key").select("hub", "node").distinct(), "met")
        sets = of_texts(met.select("node").distinct(), _whole_sets(size), "node long, keys binary", "sets")  # a hub is a node of its block
        both = met.join(sets.withColumnRenamed("keys", "y"), "node").join(sets.toDF("hub", "x"), "hub")
        counts = both.select("hub", "x", "y").mapInArrow(tidy(_differences), "hub long, key long, nodes long").groupBy("hub", "key").agg(F.sum("nodes").alias("nodes"))
        counts = counts.join(met.groupBy("hub").agg(F.count("*").alias("all")), "hub").where(F.col("nodes") * COMMON >= F.col("all"))
        common = counts.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("nodes", "key")))["key"].alias("common"))  # COMMON times the mean difference at most
        both = both.join(stored(common, "common"), "hub", "left").select("hub", "node", "x", "y", "common")
        return stored(both.mapInArrow(_deltas(percent), "key long, hub long, node long, n int"), "deltas")

    large = postings.where((F.col("m") > SMALL) & (F.col("m") <= TILE))
    big, near_hub = postings.where(F.col("m") > max(SMALL, TILE)), None
    for _ in range(LEVELS):
        if not big.take(1):
            break
        rows = dealt_anew(big)
        links = rows.where(F.col("key").isNull()).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), F.lit(True).alias("linked"))
        near_hub = links if near_hub is None else near_hub.union(links)
        rows = blocks(rows.where(F.col("key").isNotNull()).select("key", "node", "n"))
        large, big = large.union(rows.where(F.col("m") <= TILE)), rows.where(F.col("m") > TILE)
    large = large.union(big)

    labels, tried = stored(postings.select("node").distinct().withColumn("label", F.col("node")), "labels"), None
    if near_hub is not None:
        tried = stored(near_hub.distinct(), "verified")
        labels = merged(labels, tried)
        named = large.join(labels, "node")
        open_ = named.groupBy("key").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("key")
        large = stored(large.join(open_, "key", "left_semi"), "large")  # a block of one group is done

    # Large blocks: tiles.
    in_large = large.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # no more than the prefix has
    marks = of_texts(in_large.select("node"), _bitmaps(size, TILE_BYTES), "node long, bitmap binary, n long", "bitmaps")
    marks = stored(in_large.join(marks.select("node", "bitmap"), "node"), "marks")

    def tile_pairs(labels: DataFrame, forest: bool, before: DataFrame | None) -> DataFrame:
        """Pairs of tiles; only of those that had any in the round ``before``, since merging groups makes no new ones."""
        rows = large.join(labels.withColumnRenamed("label", "grp"), "node")
        split = rows.groupBy("key").agg((F.min("grp") < F.max("grp")).alias("split")).where("split").select("key")  # a block of one group is done
        rows = rows.join(split, "key", "left_semi")
        cuts = F.ceil(F.col("m") / TILE).cast("int")
        own = F.pmod(F.xxhash64("node"), cuts).cast("int")
        whole = rows.where(F.col("m") <= TILE).withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
        rows = whole.union(rows.where(F.col("m") > TILE).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1))))
        rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "n", "node", "grp", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
        if before is not None:
            rows = rows.join(before.select("key", "low", "high").distinct(), ["key", "low", "high"], "left_semi")
        mixed = rows.groupBy("key", "low", "high").agg((F.min("grp") < F.max("grp")).alias("mixed")).where("mixed").drop("mixed")  # the others have nothing to tell
        rows = rows.join(mixed, ["key", "low", "high"], "left_semi").join(marks, "node")
        rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        return stored(rows.mapInArrow(_tiles(percent, forest), "a long, b long, la long, lb long, estimate long, key long, low long, high long"), "tiles")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
        sets = of_texts(wanted, _whole_sets(size), "node long, keys binary", "sets")
        left = sets.select(F.col("node").alias("a"), F.col("keys").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("keys").alias("y"))
        return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long, linked boolean"), "verified")

    # Each node of a large block with the block's first node of about its size.
    near_size = F.floor(F.log("n") / F.log(F.lit(100 / percent)))
    sized = large.select("key", "node", near_size.alias("size"))
    first_of = sized.groupBy("key", "size").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("hub")).select("key", "size", F.col("hub.node").alias("hub"))
    hubs = sized.join(first_of, ["key", "size"]).where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    hubs = hubs.groupBy("a", "b").agg(F.count("*").alias("shared"))

    first_tries = _best(close.unionByName(hubs), "a", "b", "shared", 1)
    first_tries = verified(first_tries if tried is None else first_tries.join(tried, ["a", "b"], "left_anti"))
    tried = first_tries if tried is None else tried.union(first_tries)
    labels, tiles = merged(labels, first_tries.where("linked")), None
    for _ in range(ROUNDS):
        tiles = tile_pairs(labels, True, tiles)
        more = verified(_best(tiles, "la", "lb", "estimate", TRIES).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(more)
        if not more.where("linked").take(1):
            break
        labels = merged(labels, more.where("linked"))

    between = close.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la != lb").select("a", "b")
    between = stored(between.union(tile_pairs(labels, False, tiles).select("a", "b")).distinct().join(tried, ["a", "b"], "left_anti"), "between")
    ends = stored(between.select(F.col("a").alias("node")).union(between.select("b")).distinct(), "ends")
    fine = of_texts(ends, _bitmaps(size, BITMAP_BYTES), "node long, bitmap binary, n long", "fine")
    left, right = fine.toDF("a", "x", "n"), fine.toDF("b", "y", "m")
    last = verified(between.join(left, "a").join(right, "b").mapInArrow(_reachable(percent), "a long, b long"))
    labels = merged(labels, last.where("linked"))
    return nodes.join(labels, "node", "left").select("doc_id", "text_id", "n", F.coalesce("label", "node").alias("label"))


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its group)."""
    rows = stored(groups(docs, size, percent), "groups")
    smallest = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    out = rows.join(smallest, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def keep(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all their columns) that are the first of their group, by doc_id and then by a hash of the text.

    Of rows with one doc_id and one text, one stays (the first by its columns as JSON). Rows with a null doc_id all stay.
    """
    rows = stored(groups(docs, size, percent).where(F.col("doc_id").isNotNull()), "groups")
    first = rows.where("n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "text_id")).alias("first"))
    gone = rows.where("n > 0").join(first, "label").where(F.struct("doc_id", "text_id") != F.col("first")).select("doc_id", "text_id").distinct()
    gone = stored(gone.toDF("gone_id", "gone_text"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    out = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_text"]), "left_anti")
    if rows.groupBy("doc_id", "text_id").count().where("count > 1").take(1):
        line = "_line"
        while line in docs.columns:
            line = "_" + line
        nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.to_json(F.struct(*docs.columns))))
        single = out.where(F.col("doc_id").isNotNull()).withColumn(line, nth).where(F.col(line) == 1).drop(line)
        out = single.unionByName(out.where(F.col("doc_id").isNull()))
    return out
