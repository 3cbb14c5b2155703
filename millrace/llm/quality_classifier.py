"""Quality classifier: a sparse rule ensemble over text statistics.

1. ``features``: statistics of each whole text (shares and means; see FEATURES). Nothing else is an input of a score.
2. ``train``: boosted trees (Spark ML) on labelled rows; each path from a root to a node becomes a conjunctive rule
   (``mean_word > 4.1 AND upper_share <= 0.3``); a lasso logistic regression (Spark ML, elastic net 1.0) weighs the rules.
3. ``score_column``: rules with weight compile to Spark column expressions; scoring is a projection, with no Python in it beyond
   the statistics.

Labels are learned from rows outside the held-out fifth (crc32 of doc_id as text, modulo 5, is 0), from TRAIN_ROWS of them at most,
picked by a hash of doc_id. Null and empty texts have all statistics 0 and get the score of those. Labels with null quality or with a
doc_id that occurs in no document are not used; without labels of both values the score is the share of label 1 (0.5 if none).
Repeated documents get a row each. Extra columns are ignored.
"""

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import small_batches, stored, text_chunks, tidy, utf8
from millrace.llm.quality_rules import CHAR_CLASSES, TextStats

#: At most so many labelled rows train the model (a bounded sample; all rows are scored).
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_words", "mean_word", "symbol_share", "repeat_share", "dup_line_share", "distinct_share", "words_per_line", "common_share",
    "lower_share", "upper_share", "digit_share", "space_share", "punctuation_share", "other_symbol_share", "other_share", "top_common_share",
)


def _append(prefix: str):
    """A mapInArrow function that adds the FEATURES, named with ``prefix``, to rows with a text."""

    @tidy
    def run(batches):
        for cut in text_chunks(batches):
            s = TextStats(*utf8(cut.column("text")))
            div = lambda a, b: np.asarray(a, float) / np.maximum(b, 1)
            common = s.words[:, :-1]
            columns = [
                np.log1p(s.n_words), div(s.word_chars, s.n_words), div(s.n_symbols, s.n_chars), div(s.n_repeat_words, s.n_words), div(s.n_dup_lines, s.n_lines),
                div(s.n_distinct, s.n_words), div(s.n_words, s.n_lines), div(common.sum(1), s.n_words), *(div(s.classes[:, i], s.n_chars) for i in range(len(CHAR_CLASSES))), div(common.max(1), s.n_words),
            ]
            names = [*cut.schema.names, *(prefix + f for f in FEATURES)]
            yield pa.RecordBatch.from_arrays([*cut.columns, *(pa.array(np.round(c, 6), pa.float64()) for c in columns)], names=names)

    return run


def features(docs: DataFrame, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and the FEATURES of each text, named with ``prefix``."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + f, T.DoubleType()) for f in FEATURES)])
    return small_batches(docs).mapInArrow(_append(prefix), schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


Condition = tuple[str, str, float]


def _paths(tree: str) -> list[tuple[Condition, ...]]:
    """The conditions of every path from the root to a node, from the printed form of one tree."""
    out, stack = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, (FEATURES[int(m[3])], m[4], float(m[5])))]
            out.append(tuple(x[1] for x in stack))
    return out


def rule_column(rule: tuple[Condition, ...], prefix: str = "") -> Column:
    """A conjunctive rule as a boolean column."""
    parts = [F.col(prefix + f) <= v if op == "<=" else F.col(prefix + f) > v for f, op, v in rule]
    return reduce(lambda a, b: a & b, parts)


class RuleModel:
    """An intercept and weighted conjunctive rules over FEATURES."""

    def __init__(self, intercept: float, rules: list[tuple[tuple[Condition, ...], float]]):
        self.intercept, self.rules = intercept, rules

    def score_column(self, prefix: str = "") -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule_column(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.round(1 / (1 + F.exp(-margin)), 6)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 3, penalty: float = 0.002) -> RuleModel:
    """A RuleModel from the texts of ``docs`` and the given ``labels`` (doc_id, quality 0/1), of which ``rows`` are used at most.

    The labels are few enough to broadcast by that bound, so the documents are not shuffled.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    data = stored(features(texts).select("label", *FEATURES), "training").coalesce(4).cache()
    ones = {r.label: r.n for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(ones.values())
    share = ones.get(1.0, 0) / total if total else 0.5
    if not total or not 0 < share < 1:
        data.unpersist()
        p = min(max(share, 0.001), 0.999)
        return RuleModel(float(np.log(p / (1 - p))), [])
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(data)
    model = GBTClassifier(featuresCol="x", maxIter=trees, maxDepth=depth, seed=7, maxBins=64).fit(assembled)
    rules = list(dict.fromkeys(r for tree in model.trees for r in _paths(tree.toDebugString)))
    columns = [rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(data.select("label", *columns))
    lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=penalty, maxIter=80).fit(fired)
    data.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels.where(~held_out()), rows)
    scored = features(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), model.score_column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents (all their columns) whose predicted label is 1."""
    prefix = "stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    model = train(docs, labels.where(~held_out()), rows)
    return features(docs, prefix).where(model.score_column(prefix) >= THRESHOLD).select(*docs.columns)
