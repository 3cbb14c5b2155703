import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_classifier, quality_rules
from tests.llm.helpers import documents, empty, pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_match_brute_force(spark):
    docs = documents(spark)
    got = pairs(quality_rules.score(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)
    assert got == want


def test_base_failed_is_never_kept_and_extra_columns_do_not_matter(spark):
    plain = pairs(quality_rules.score(documents(spark)), "doc_id", "base_failed", "kept", "char_distance")
    assert plain == pairs(quality_rules.score(documents(spark, extra=True)), "doc_id", "base_failed", "kept", "char_distance")
    assert not any(failed and kept for _, failed, kept, _ in plain)


def test_distance_rejects_odd_histograms(spark):
    text = "the cat and the dog of that house are with us for it is what they have and we go on by the river "
    odd = "#$%& " * 60 + " ".join(f"z{i}" for i in range(60))
    rows = [(i, text + f" word{i} " + " ".join(f"plain{i}{j}" for j in range(40)), "en") for i in range(30)] + [(99, odd, "en")]
    kept = dict(pairs(quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "doc_id", "kept"))
    assert not kept[99] and all(kept[i] for i in range(30))


def test_js_distance_bounds():
    p, q = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]), np.array([[0.0, 1.0], [2.0, 2.0], [1.0, 0.0]])
    assert np.allclose(quality_rules.js_distance(p, q), [1.0, 0.0, 0.0])


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.score(empty(spark)).count() == 0
    assert quality_classifier.score(empty(spark), labels).count() == 0
    assert quality_classifier.keep(empty(spark), labels).count() == 0


def _labelled(spark, n=400):
    rows = [(i, ("good plain words of text and more of it " * 9) if i % 3 else ("#### $$$ %%% BAD!! " * 15), i % 3 and 1) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, int(bool(q)), 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifier_learns_and_separates_held_out(spark):
    docs, labels = _labelled(spark)
    rows = quality_classifier.score(docs, labels).join(labels.where("quality is not null").dropDuplicates(["doc_id"]), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert held and all(r.predicted == r.quality for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality_classifier.THRESHOLD) for r in rows)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = _labelled(spark)
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert pairs(quality_classifier.score(docs, labels), "doc_id", "score") == pairs(quality_classifier.score(docs, turned), "doc_id", "score")


def test_classifier_on_hostile_rows(spark):
    _, labels = _labelled(spark)
    training, _ = _labelled(spark)
    docs = documents(spark, extra=True)
    kept = quality_classifier.keep(docs, labels.where("doc_id < 0"))
    assert kept.columns == docs.columns and kept.count() == docs.count()  # no labels: score 0.5
    scored = quality_classifier.score(documents(spark).unionByName(training), labels)
    assert scored.count() == 18 + 400 and scored.where("score is null or predicted is null or held_out is null").count() == 0


@pytest.mark.parametrize("tree,want", [("", []), ("If (feature 0 <= 1.5)\n Predict: 1\nElse (feature 0 > 1.5)\n Predict: 0", [(("log_words", "<=", 1.5),), (("log_words", ">", 1.5),)])])
def test_paths(tree, want):
    assert quality_classifier._paths(tree) == want
