"""From raw records to catalogue rows: choice of fields, gates, hashes, chunks."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import arrays, text

#: What stands for "nothing" in sources.
PLACEHOLDERS = ("-", "--", "없음", "해당없음", "n/a", "na", "none", "null")
#: What stands for a title or a description, and hints of spam and of project pages.
EMPTY_TEXTS = (
    "test", "tests", "todo", "tbd", "dummy", "none", "null", "n/a", "na", "sample", "temp", "tmp", "desc", "description", "dataset", "unknown", "undefined", "no description found",
    "not applicable", "{{description}}", "nan", "title", "data", "untitled", "new", "wip", "update", "refer image",
)
SPAM = ("reviews", "gummies", "buy now", "affiliate", "facebook.com/share", "omeka.net", "nas.io")
PROMO = ("paper", "project page", "released resources", "repo", "code", "website", "model card")


def meaningful(x: Column) -> Column:
    return F.coalesce((F.trim(x) != "") & ~F.lower(F.trim(x)).isin(*PLACEHOLDERS), F.lit(False))


def choose(first: Column, second: Column) -> Column:
    """The first value that means something."""
    return F.when(meaningful(first), F.trim(first)).when(meaningful(second), F.trim(second))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(text.blank_to_null(c) for c in columns))


def pick(df: DataFrame, *aliases: str) -> Column:
    """The first column with content whose name is an alias, whatever its case and punctuation."""
    import re

    plain = lambda s: re.sub(r"[^0-9a-z가-힣]", "", s.lower())
    names = {plain(c): c for c in df.columns}
    found = [F.col(f"`{names[plain(a)]}`").cast("string") for a in aliases if plain(a) in names]
    return first_non_empty(*found) if found else F.lit(None).cast("string")


def _empty_of_sense(t: Column) -> Column:
    """What neither a title nor a description may be: a placeholder, marks, one url, an unfilled template, a slug, broken characters."""
    return F.lower(t).isin(*EMPTY_TEXTS) | t.rlike(r"^[^\p{L}\p{N}]+$") | t.rlike(r"(?i)^https?://\S+$") | (t.contains("{{") & t.contains("}}")) | t.rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") | t.contains("\ufffd")


def bad_title(x: Column) -> Column:
    """Titles that cannot name a data set."""
    t = text.clean(x)
    n, letters = F.char_length(t), t.rlike("[A-Za-z가-힣]")
    return F.coalesce(_empty_of_sense(t) | (n <= 2) | ((n <= 8) & ~t.contains(" ")) | t.rlike(r"^(.)\1{2,}$") | (~letters & (n <= 20)), F.lit(True))


def bad_description(x: Column) -> Column:
    """Descriptions that say nothing: placeholders, few words, mostly urls, spam, navigation, no letters."""
    t = text.clean(x)
    n, lower, urls = F.char_length(t), F.lower(t), F.regexp_count(t, F.lit(r"(?i)https?://\S+"))
    return F.coalesce(
        _empty_of_sense(t) | (n <= 5) | ((n <= 30) & (F.size(F.split(t, " ")) <= 3)) | ((urls >= 2) & (n <= 220)) | ((urls >= 1) & (n <= 120)) | lower.rlike("|".join(w.replace(".", "[.]") for w in SPAM))
        | (lower.rlike("|".join(PROMO)) & t.contains("|")) | lower.startswith("see the full description on the dataset page") | (~t.rlike("[A-Za-z가-힣]") & (n <= 80)),
        F.lit(True),
    )


def bad_record(title: Column, short: Column, long: Column, source: Column, exempt: tuple[str, ...] = ("PUBLIC_DATA_PORTAL",)) -> Column:
    """Records that are not taken: a bad title or description, but for sources that are taken whole."""
    return ~F.coalesce(source.isin(*exempt), F.lit(False)) & (bad_title(title) | bad_description(F.coalesce(text.clean(long), text.clean(short))))


def presence(**fields: Column) -> Column:
    """map of field to whether it has content."""
    pairs = [p for n, c in fields.items() for p in (F.lit(n), F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)))]
    return F.create_map(*pairs)


def field_presence(scalars: dict[str, Column], lists: dict[str, Column], objects: dict[str, Column]) -> Column:
    """struct(has, array_lengths, json_key_counts) of a record: scalars by content, arrays by length, JSON objects by number of keys."""
    lengths = {n: F.coalesce(F.size(c), F.lit(0)) for n, c in lists.items()}
    keys = {n: F.coalesce(F.size(F.json_object_keys(c)), F.lit(0)) for n, c in objects.items()}
    has = {n: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) for n, c in scalars.items()} | {n: c > 0 for n, c in (lengths | keys).items()}
    made = {k: F.create_map(*(x for n, c in m.items() for x in (F.lit(n), c))) if m else F.create_map().cast("map<string,int>") for k, m in (("has", has), ("array_lengths", lengths), ("json_key_counts", keys))}
    return F.struct(*(c.alias(k) for k, c in made.items()))


def record_hash(**fields: Column) -> Column:
    """sha256 of the record as JSON with sorted keys, empty fields left out."""
    return F.sha2(F.to_json(F.struct(*(text.blank_to_null(fields[n].cast("string")).alias(n) for n in sorted(fields)))), 256)


def search_text(*parts: Column) -> Column:
    """Cleaned parts, without repetitions in other case, one to a line."""
    return F.nullif(F.array_join(arrays.unique_ci(F.array(*(text.clean(p) for p in parts))), " \n"), F.lit(""))


def cross_filled(canonical: Column, landing: Column) -> tuple[Column, Column]:
    """Two http(s) urls, each standing in for the other."""
    valid = lambda u: F.when(u.rlike("^https?://[^/ ]+"), u)
    return F.coalesce(valid(canonical), valid(landing)), F.coalesce(valid(landing), valid(canonical))


def title_or_null(title: Column, key: Column) -> Column:
    """Null where the title is just the opaque key."""
    return F.when(~F.coalesce((title == key) & key.rlike("^([0-9]+|[0-9a-f-]{36})$"), F.lit(False)), title)


def chunks(rows: DataFrame, key: str, **texts: Column) -> DataFrame:
    """key, chunk_type, chunk_order, chunk_text: one row for each named text that is not blank."""
    made = F.array(*(F.struct(F.lit(n).alias("chunk_type"), F.lit(i).alias("chunk_order"), text.blank_to_null(c).alias("chunk_text")) for i, (n, c) in enumerate(texts.items())))
    return rows.select(key, F.explode(F.filter(made, lambda x: x["chunk_text"].isNotNull())).alias("c")).select(key, "c.*")


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashes of words, over their norm."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h & 0x10000 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return run


def embedded(rows: DataFrame, column: str, embedder: Callable[[list[str]], np.ndarray], batch: int = 100) -> DataFrame:
    """``rows`` with ``embedding``: texts go to ``embedder`` in batches, inside tasks."""

    def run(frames):
        for pdf in frames:
            vectors = [v for i in range(0, len(pdf), batch) for v in embedder(pdf[column].tolist()[i : i + batch])]
            yield pdf.assign(embedding=pd.Series(list(vectors), index=pdf.index, dtype=object))

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
