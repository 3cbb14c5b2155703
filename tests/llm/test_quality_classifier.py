"""The classifier against plain loops: statistics, rules, and the sums that make a score."""

import math
import re
from collections import Counter

import pytest

from millrace.llm import quality_classifier
from millrace.llm.quality_rules import COMMON_WORDS
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.001"
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[\x00-\x08\x0E-\x1F\x7F#$%&*+/<=>@\[\\\]^_`{|}~]", r"[^\x00-\x7F]")


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    folded = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    common = Counter(w for w in (re.sub("[.,;:!?]$", "", w) if len(w) > 1 else w for w in folded) if w in COMMON_WORDS)
    div = lambda a, b: a / max(b, 1)
    n, chars = len(words), len(text)
    classes = [len(re.findall(c, text)) for c in CLASSES]
    values = [
        math.log1p(n), div(sum(map(len, words)), n), div(len(re.findall("[#*$%&|<>]", text)), chars), div(len(covered), n), div(len(lines) - len(set(lines)), len(lines)), div(len(set(words)), n),
        div(n, len(lines)), div(sum(common.values()), n), *(div(c, chars) for c in classes), div(max(common.values(), default=0), n),
    ]
    return dict(zip(quality_classifier.FEATURES, values, strict=True))


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    return docs, {(r.doc_id, r.text): statistics(r.text) for r in docs.collect()}


def test_features_equal_plain_loops(corpus):
    docs, want = corpus
    for r in quality_classifier.features(docs.select("doc_id", "text")).collect():
        for name, value in want[r.doc_id, r.text].items():
            assert r[name] == pytest.approx(value, abs=2e-6), (r.doc_id, name)


def test_scores_are_the_sums_of_the_rules_that_hold(spark, corpus):
    docs, want = corpus
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.train(docs, labels.where(~quality_classifier.held_out()))
    assert model.rules and all(1 <= len(rule) <= 3 for rule, _ in model.rules)
    rows = quality_classifier.features(docs.select("doc_id", "text")).withColumn("score", model.score_column()).collect()
    for r in rows:
        margin = model.intercept + sum(w for rule, w in model.rules if all(r[f] <= v if op == "<=" else r[f] > v for f, op, v in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)
    scores = {(r.doc_id, r.text): r.score for r in rows}
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for s in quality_classifier.score(docs, labels).where("doc_id >= 20").collect():
        assert s.score == pytest.approx(scores[s.doc_id, texts[s.doc_id]], abs=1e-6)
