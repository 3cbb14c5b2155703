"""Keyed tables: latest rows, merges, reconciliation, paging."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``. Spark cuts each group before and after the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new``: known keys are overwritten, all but ``keep``, which stay as they were; unknown keys are added.

    ``new`` has one row for each key (see ``latest``).
    """
    joined = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    there, fresh = F.coalesce(*(F.col(f"o.{k}") for k in keys)).isNotNull(), F.coalesce(*(F.col(f"n.{k}") for k in keys)).isNotNull()
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in keep:
            columns.append(F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            columns.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def reconcile(known: DataFrame, seen: DataFrame, key: str, allowed: bool = True) -> DataFrame:
    """ACTIVE rows of ``known`` that a full, faultless run has not seen become INACTIVE."""
    if not allowed:
        return known
    marked = known.join(seen.select(F.col(key).alias("_seen")).distinct(), F.col(key) == F.col("_seen"), "left")
    gone = (F.col("status") == "ACTIVE") & F.col("_seen").isNull()
    return marked.withColumn("status", F.when(gone, "INACTIVE").otherwise(F.col("status"))).drop("_seen")


def may_reconcile(from_scratch: bool, limited: bool, failed: int, seen: int) -> bool:
    return from_scratch and not limited and failed == 0 and seen > 0


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page in a total order: a top-k of (number + 1) * size rows, not a sort of all."""
    size, number = (size if size > 0 else 10), max(number, 0)
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_of_blocks(blocks: list[DataFrame], offset: int, size: int, key: str) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the blocks one after the other, each in the order of ``key``.

    Each block is paged on its own, from its nearer end, so a page at a block's end is a small top-k however long the block is.
    """
    out, low, high = None, offset, offset + size
    for block in blocks:
        n = block.count()
        first, last = max(low, 0), min(high, n)
        if first < last:
            if first <= n - last:
                part = block.orderBy(F.asc(key)).limit(last)
                part = part.offset(first) if first else part
            else:
                part = block.orderBy(F.desc(key)).limit(n - first)
                part = part.offset(n - last) if n > last else part
            out = part if out is None else out.unionByName(part)
        low, high = low - n, high - n
    return blocks[0].limit(0) if out is None else out


def envelope(rows: DataFrame, number: int, size: int) -> DataFrame:
    """total, pages, has_next of a listing."""
    pages = F.when(F.lit(size) > 0, F.ceil(F.col("total") / F.lit(max(size, 1)))).otherwise(F.lit(1))
    return rows.agg(F.count("*").alias("total")).withColumn("pages", pages.cast("bigint")).withColumn("has_next", F.lit(number + 1) < F.col("pages"))
