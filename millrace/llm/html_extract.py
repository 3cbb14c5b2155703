"""Main text of web pages by wrapper induction.

1. Each page's tree of block elements is read by one pass over its tags; text runs are leaves, inside an article (or main)
   element too.
2. Pages of one host share a wrapper. Each layout of the host (the paths of elements outside articles) that LEAST_PAGES pages have, and its most
   common one, has its page of smallest id as reference; every other page is aligned to that of its layout, or to the most common one's, by simple tree matching
   (a largest number of nodes of equal label in order, children by dynamic programming, equal subtrees before others). Leaves aligned with
   one reference node vote with their text; one text with ``SHARE`` of the votes, from ``LEAST_PAGES`` pages that differ (in their articles,
   where they have any), makes the node constant: template. A leaf inside an article counts by stories
   instead: a page's story is the longest other leaf of its article, and a text at one node is constant if it stands beside SHARE of all
   stories of the host, and LEAST_PAGES of them. So stories that are repeated, with changes or without, are no template.
   Votes are counted exactly, in two aggregations with partial ones before them, and a layout's pages meet its reference in salted parts, so a
   host may have any share of all pages.
3. Extraction: leaves in elements for menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments are left
   out, by tag or by class and id words. If the page has an article (or main) with text, the text is that; otherwise that of the page; of either, the varying slots.
   A host's template is a set of 64-bit keys of (path, text); hosts with one are joined by broadcast up to BROADCAST_ROWS keys.

Alignment is exact at any depth and width: how many nodes two subtrees can match depends on their shapes alone, and is remembered for each pair of
shapes; the matching itself then goes from the root down, with tables of at most TABLE_CELLS cells (wider lists are halved, in linear space).

Null and empty pages: empty text. Null urls and urls without a host have no wrapper. Repeated pages vote once each and get a row each; ties for
the smallest id are settled by url. An empty table gives no rows; extra columns are ignored.
"""

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, text_chunks
from millrace.llm.url_filter import host_and_path

SHARE = 0.5
LEAST_PAGES = 3
BROADCAST_ROWS = 200_000
#: Parts that the pages of a host's layout are dealt to where they meet their reference.
SALTS = 16
#: Cells of an alignment table held at once.
TABLE_CELLS = 1 << 20
#: Pairs of shapes whose matching a worker remembers.
SHAPES = 200_000

#: Elements that are never content, those that make blocks, raw text, and words of class or id.
DROPPED = frozenset("nav footer aside form script style noscript template button select iframe svg canvas object head dialog menu textarea audio video".split())
BLOCKS = frozenset(
    "html body address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul caption details summary dialog".split()
) | DROPPED
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer form header masthead menu nav navbar navigation newsletter notice notices popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: An opening tag of these ends an open element of those.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset(("ul", "ol", "dl", "table", "body", "html"))
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@lru_cache(4096)
def _chrome(attributes: str) -> bool:
    words = set()
    for m in _ATTR.finditer(attributes):
        words.update(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()))
    return bool(words & CHROME_WORDS)


@lru_cache(4096)
def _label(tag: str, attributes: str) -> str:
    m = _ATTR.search(attributes)
    return f"{tag}.{(m[2] or m[3] or m[4] or '')}" if m else tag


class Node:
    """An element, or a leaf with its text; ``key`` names its path, and a leaf's text too."""

    __slots__ = ("label", "tag", "dropped", "main", "children", "parent", "key", "text")

    def __init__(self, label, tag, parent, dropped, main, text=None):
        self.label, self.tag, self.parent, self.dropped, self.main, self.text = label, tag, parent, dropped, main, text
        self.children: list[Node] = []
        self.key = xxhash.xxh64_intdigest(label if text is None else text, parent.key if parent is not None else 0)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root of a page's block tree, and its text leaves in order."""
    root = Node("", "", None, False, False)
    here, leaves, run = root, [], []

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                leaf = Node("#", "#", here, here.dropped, here.main, text)
                here.children.append(leaf)
                leaves.append(leaf)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
                node = here
                while node is not root and node.tag != tag:
                    node = node.parent
                if node is not root:
                    here = node.parent
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in RAW:
            if tag in ("title",):
                flush()
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag in VOID:
            continue
        node = here
        while node is not root and node.tag == "p":  # a block ends an open paragraph
            node = node.parent
        here = node
        if tag in _CLOSES:
            node = here
            while node is not root and node.tag not in _STOPS:
                if node.tag in _CLOSES[tag]:
                    here = node.parent
                    break
                node = node.parent
        main = here.main or tag in MAIN
        dropped = here.dropped or tag in DROPPED or (tag == "header" and not main) or _chrome(m[3])
        node = Node(_label(tag, m[3]), tag, here, dropped, main)
        here.children.append(node)
        here = node
    flush()
    return root, leaves


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def skeleton(root: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, label (a hash), key (0 but for leaves), and whether inside an article, of the nodes in order."""
    out = []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        out.append((depth, _hash(node.label), leaf_key(node) if node.text is not None else 0, node.parent is not None and node.parent.main))
        stack.extend((c, depth + 1) for c in reversed(node.children))
    return tuple(np.array(c, t) for c, t in zip(zip(*out, strict=True), (np.int32, np.int64, np.int64, np.bool_), strict=True))


def layout(root: Node) -> int:
    """Names the paths of elements outside articles."""
    paths, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node.text is None:
            paths.add(node.key)
            if not node.main:
                stack.extend(node.children)
    return _hash(np.array(sorted(paths), np.uint64).tobytes())


def leaf_key(leaf: Node) -> int:
    return leaf.key - (1 << 63)


class Shapes:
    """Shapes of subtrees (label and child shapes), numbered, and the largest ordered matching of any two."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.labels: list[int] = []
        self.kids: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def number(self, label: int, kids: list[int]) -> int:
        name = (label, *kids)
        if name not in self.numbers:
            self.numbers[name] = len(self.labels)
            self.labels.append(label)
            self.kids.append(np.array(kids, np.int64))
            self.sizes.append(1 + sum(self.sizes[k] for k in kids))
        return self.numbers[name]

    def matched(self, a: int, b: int) -> int:
        """Nodes that subtrees of shapes a and b match at most (0 for other labels)."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.known:
                stack.pop()
                continue
            if x == y or self.labels[x] != self.labels[y]:
                self.known[x, y] = self.sizes[x] if x == y else 0
                continue
            left, right = self.kids[x], self.kids[y]
            asked = [(p, q) for p in set(left.tolist()) for q in set(right.tolist()) if (p, q) not in self.known]
            if asked:
                stack.extend(asked)
                continue
            same = _ends(left, right)
            total = 1 + sum(self.sizes[k] for k in (*left[: same[0]], *left[len(left) - same[1] :]))
            left, right = left[same[0] : len(left) - same[1]], right[same[0] : len(right) - same[1]]
            self.known[x, y] = total + int(_last_row(self.table(left, right))[-1])
        return self.known[a, b]

    def table(self, left: np.ndarray, right: np.ndarray):
        """The weights of each of ``left`` with all of ``right``, row by row."""
        kinds, at = np.unique(right, return_inverse=True)
        kinds = kinds.tolist()
        rows: dict[int, np.ndarray] = {}
        for x in left.tolist():
            if x not in rows:
                rows[x] = np.array([self.matched(x, k) for k in kinds], np.int64)
            yield rows[x][at]


def _ends(left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """How many first and last entries are equal."""
    n = min(len(left), len(right))
    differ = np.flatnonzero(left[:n] != right[:n])
    first = int(differ[0]) if len(differ) else n
    n -= first
    differ = np.flatnonzero(left[len(left) - n :][::-1] != right[len(right) - n :][::-1])
    return first, int(differ[0]) if len(differ) else n


def _step(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of the table of greatest matchings."""
    out = np.zeros_like(row)
    np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights), out=out[1:])
    return out


def _last_row(weights) -> np.ndarray:
    row = None
    for w in weights:
        row = _step(np.zeros(len(w) + 1, np.int64) if row is None else row, w)
    return np.zeros(1, np.int64) if row is None else row


def matching(rows, n: int, m: int) -> list[tuple[int, int]]:
    """A greatest ordered matching by weights: ``rows(low, high, turned)`` gives those of left entries, from low to high, backwards if turned."""
    out: list[tuple[int, int]] = []
    parts = [(0, n, 0, m)]
    while parts:
        a, b, c, d = parts.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= TABLE_CELLS or b - a == 1:
            table, weights = [np.zeros(d - c + 1, np.int64)], []
            for w in rows(a, b, False):
                weights.append(w[c:d])
                table.append(_step(table[-1], w[c:d]))
            p, q = b - a, d - c
            while p and q:
                if table[p][q] == table[p - 1][q]:
                    p -= 1
                elif table[p][q] == table[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    out.append((a + p, c + q))
            continue
        middle = (a + b) // 2
        before = _last_row(w[c:d] for w in rows(a, middle, False))
        after = _last_row(w[c:d][::-1] for w in rows(middle, b, True))
        cut = c + int((before + after[::-1]).argmax())
        parts += [(a, middle, c, cut), (middle, b, cut, d)]
    return out


class Tree:
    """A skeleton with children, and the shape, size and name of each subtree."""

    def __init__(self, depth: np.ndarray, label: np.ndarray, key: np.ndarray, shapes: Shapes):
        n = len(depth)
        self.label, self.key = label.tolist(), key.tolist()
        self.kids: list[list[int]] = [[] for _ in range(n)]
        path: list[int] = []
        for i, d in enumerate(depth.tolist()):
            del path[d:]
            if path:
                self.kids[path[-1]].append(i)
            path.append(i)
        self.shape, self.size, self.name = [0] * n, [1] * n, [0] * n
        for i in range(n - 1, -1, -1):
            kids = self.kids[i]
            self.shape[i] = shapes.number(self.label[i], [self.shape[k] for k in kids])
            self.size[i] += sum(self.size[k] for k in kids)
            self.name[i] = hash((self.label[i], self.key[i], *(self.name[k] for k in kids)))


def align(page: Tree, reference: Tree, shapes: Shapes) -> dict[int, int]:
    """Simple tree matching: page node -> reference node, a largest ordered matching of nodes with equal labels, equal subtrees before others."""
    out: dict[int, int] = {}
    stack = [(0, 0)] if page.label and reference.label and page.label[0] == reference.label[0] else []
    while stack:
        i, j = stack.pop()
        if page.name[i] == reference.name[j]:
            out.update(zip(range(i, i + page.size[i]), range(j, j + page.size[i])))
            continue
        out[i] = j
        left, right = page.kids[i], reference.kids[j]
        x, y = (np.array([t.name[k] for k in kids], np.int64) for t, kids in ((page, left), (reference, right)))
        first, last = _ends(x, y)
        stack.extend(zip(left[:first], right[:first]))
        stack.extend(zip(left[len(left) - last :], right[len(right) - last :]))
        left, right, x, y = left[first : len(left) - last], right[first : len(right) - last], x[first : len(x) - last], y[first : len(y) - last]
        if not left or not right:
            continue
        if len(left) == len(right) == 1:
            if page.label[left[0]] == reference.label[right[0]]:
                stack.append((left[0], right[0]))
            continue
        kinds = np.array([reference.shape[k] for k in right], np.int64)

        def rows(low, high, turned, left=left, x=x, y=y, kinds=kinds):
            some = range(high - 1, low - 1, -1) if turned else range(low, high)
            some_shapes = np.array([page.shape[left[p]] for p in some], np.int64)
            for p, w in zip(some, shapes.table(some_shapes, kinds)):
                yield w + (x[p] == y) * page.size[left[p]]

        stack.extend((left[p], right[q]) for p, q in matching(rows, len(left), len(right)))
    return out


def main_text(page: str, template: frozenset[int] | set[int]) -> str:
    """The text of a page under its host's template."""
    _, leaves = parse(page)
    kept = [x for x in leaves if not x.dropped]
    kept = [x for x in kept if x.main] or kept
    return "\n\n".join(x.text for x in kept if not template or leaf_key(x) not in template)


def stories(leaves: list[Node]) -> tuple[int | None, int | None, int | None]:
    """Of the longest leaf of an article: the hash of its text, and its key; and the hash of the next longest text."""
    inside = sorted({x.text: x for x in leaves if x.main and not x.dropped}.values(), key=lambda x: (-len(x.text), x.text))[:2]
    first, second = [*inside, None, None][:2]
    return first and _hash(first.text), first and leaf_key(first), second and _hash(second.text)


_SKELETON = "page_id long, url string, host string, layout long, depths binary, labels binary, keys binary, inside binary, article long, story long, story_key long, other_story long"


def _skeletons(batches):
    for b in text_chunks(batches, "html"):
        parts, layouts, articles, told = [], [], [], []
        for page in b.column("html").to_pylist():
            root, leaves = parse(page or "")
            parts.append([c.tobytes() for c in skeleton(root)])
            layouts.append(layout(root))
            articles.append(_hash("\n".join([x.text for x in leaves if x.main] or [x.text for x in leaves])))
            told.append(stories(leaves))
        columns = [b.column("page_id"), b.column("url"), b.column("host"), pa.array(layouts, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*parts, strict=True))]
        columns += [pa.array(articles, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*told, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "layout", "depths", "labels", "keys", "inside", "article", "story", "story_key", "other_story"])


def _tree_of(row: dict, shapes: Shapes) -> Tree:
    return Tree(*(np.frombuffer(row[c].as_buffer(), t) for c, t in (("depths", np.int32), ("labels", np.int64), ("keys", np.int64))), shapes)


def _votes(batches):
    """host, reference (its layout and node), key, article of every aligned leaf; inside an article, the story beside it."""
    shapes, known, tree = Shapes(), None, None
    for b in batches:
        out = []
        named = {c: b.column(c) for c in b.schema.names}
        plain = zip(*(named[c].to_pylist() for c in ("host", "layout", "article", "story", "story_key", "other_story")), strict=True)
        for r, (host, of, article, story, story_key, other) in enumerate(plain):
            if len(shapes.known) > SHAPES or len(shapes.labels) > SHAPES:
                shapes, known = Shapes(), None
            if known != (host, of):
                known, tree = (host, of), _tree_of({c: named[f"r_{c}"][r] for c in ("depths", "labels", "keys")}, shapes)
            page = _tree_of({c: named[c][r] for c in ("depths", "labels", "keys")}, shapes)
            inside = np.frombuffer(named["inside"][r].as_buffer(), np.bool_).tolist()
            for i, j in align(page, tree, shapes).items():
                if key := page.key[i]:
                    out.append((host, of, j, key, article, inside[i], (other if key == story_key else story) if inside[i] else None))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "layout", "node", "key", "article", "inside", "story"])


def wrappers(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """host, template (sorted keys of the constant leaves) of every host that has any."""
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), "html").where("host <> ''")
    trees = stored(rows.mapInArrow(_skeletons, _SKELETON), "skeletons")
    shape = F.struct("depths", "labels", "keys")
    found = trees.groupBy("host", "layout").agg(F.min_by(shape, F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("r"), F.count("*").alias("n"))
    common = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout"))
    found = found.withColumn("pages", F.sum("n").over(Window.partitionBy("host"))).withColumn("nth", common)
    found = found.where((F.col("pages") >= least) & ((F.col("n") >= least) | (F.col("nth") == 1)))
    references = stored(found.select("host", "layout", "nth", *(F.col(f"r.{c}").alias(f"r_{c}") for c in ("depths", "labels", "keys"))), "references")
    # A layout of too few pages to vote goes to the reference of the most common one.
    own = references.select("host", "layout", F.lit(True).alias("own"))
    most = references.where("nth = 1").select("host", F.col("layout").alias("most"))
    placed = trees.drop("page_id", "url").join(own, ["host", "layout"], "left").join(most, "host")
    placed = placed.withColumn("layout", F.when(F.col("own"), F.col("layout")).otherwise(F.col("most"))).drop("most", "own")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("article", "story", "keys"), F.lit(SALTS)))
    salted = references.drop("nth").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    votes = placed.join(salted, ["host", "layout", "salt"]).drop("salt").mapInArrow(_votes, "host string, layout long, node int, key long, article long, inside boolean, story long")
    # A key's voters are told apart by their article, and inside articles by the story beside them: exact counts, of distinct rows.
    leaf = ["host", "layout", "node", "key"]
    votes = stored(votes.groupBy(*leaf, "article", "story").agg(F.count("*").alias("n"), F.max("inside").alias("inside")), "votes")
    by_article = votes.groupBy(*leaf, "article").agg(F.sum("n").alias("n"), F.max("inside").alias("inside"))
    counted = by_article.groupBy(*leaf).agg(F.sum("n").alias("n"), F.count("article").alias("articles"), F.max("inside").alias("inside"))
    stories = votes.where("story is not null").select(*leaf, "story").distinct().groupBy(*leaf).agg(F.count("*").alias("stories"))
    counted = stored(counted.join(stories, leaf, "left").na.fill(0, ["stories"]), "counted")
    total = counted.where("not inside").groupBy("host", "layout", "node").agg(F.sum("n").alias("total"))
    constant = counted.where("not inside").where((F.col("n") >= least) & (F.col("articles") >= least)).join(total, ["host", "layout", "node"]).where(F.col("n") >= F.col("total") * share)
    told = trees.where("story is not null").select("host", "story").distinct().groupBy("host").agg(F.count("*").alias("told"))
    repeated = counted.where(F.col("inside") & (F.col("stories") >= least)).groupBy("host", "key").agg(F.max("stories").alias("stories")).join(told, "host").where(F.col("stories") >= F.col("told") * share)
    constant = constant.select("host", "key").unionByName(repeated.select("host", "key"))
    return constant.groupBy("host").agg(F.array_sort(F.collect_set("key")).alias("template"))


def _texts(batches):
    for b in text_chunks(batches, "html"):
        texts = [main_text(page or "", set(t or ())) for page, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    found = stored(wrappers(pages, share, least), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.size("template")), F.lit(0)).alias("n")).first().n
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_ROWS else found, "host", "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
