"""Small hostile tables."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, extra: bool = False):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, and, if asked, extra columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(0, 120, 6):
        far[i] = "other"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, "   \n\t "), (8, "Two words"), (9, "two WORDS"), (10, words(rng, 60_000, 9000)),
        (11, "é ü 文字 " * 80), (12, "x" * 5000), (2, base), (None, base), (None, "lonely text of no id"), (13, "line one here\nline one here\nline one here\n" * 9), (14, "a b"),
        (-5, words(rng, 80)),
    ]
    rows = [(i, t, lang, src, None if t is None else len(t)) for (i, t), lang, src in zip(rows, ["en", "de", None, "xx", "fr", "es"] * 3, [None, "s1", "s2"] * 6, strict=True)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("n", "node", "key", "label", "h", "pack", "length", "block", "mean_word", "stat_mean_word", "pii_email", "overlaps", "n_words", "score", "html", "host"):
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df, *columns):
    """Rows as sortable tuples."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
