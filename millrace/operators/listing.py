"""Lists of a catalogue as users ask for them: optional conditions, views, rankings, counters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import records


def optional(rows: DataFrame, title: str, keyword: str | None = None, equal: dict[str, object] | None = None) -> DataFrame:
    """``rows`` under those conditions that are given; the keyword stands anywhere in the title, in any case, with its wildcards."""
    if keyword is not None:
        rows = rows.where(F.col(title).ilike(f"%{keyword}%"))
    for column, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def active(rows: DataFrame) -> DataFrame:
    """Rows without either mark of deletion."""
    return rows.where(~F.coalesce("is_deleted", F.lit(False)) & F.col("deleted_at").isNull())


def result_view(rows: DataFrame, kind: str = "all", prices: tuple[str, ...] = (), latest: bool = False, key: str = "p_partkey") -> DataFrame:
    """Results of one type (or all), and of one price if just one is asked for; ``place`` by score, or of data sets by date."""
    if kind != "all":
        rows = rows.where(F.col("type") == kind)
    if len(prices) == 1:
        free = F.coalesce("free", F.lit(False))
        rows = rows.where(free if prices[0] == "free" else ~free)
    order = [F.desc_nulls_last("updated"), F.asc(key)] if latest and kind == "dataset" else [F.desc_nulls_last("score"), F.asc(key)]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy(*order)))


#: The sorts of posts, and what they sort by.
POST_SORTS = {"LATEST": ("created",), "VIEW_COUNT": ("views", "created"), "FAVORITE": ("likes", "created")}


def post_order(name: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in POST_SORTS[name]]


def of_user_turns(turns: DataFrame, kinds: dict[str, DataFrame], key: str = "turn_id") -> DataFrame:
    """The user turns with what each kind has for them."""
    out = turns.where("role = 'user'").select(key)
    for rows in kinds.values():
        out = out.join(rows, key, "left")
    return out


def ranked_cards(items: DataFrame, cards: DataFrame, n: int) -> DataFrame:
    """The ``n`` best items (type, id, score), ranked over both types; with their card, or with what went wrong and no rank."""
    order = [F.desc_nulls_last("score"), F.asc("type"), F.asc("id")]
    best = items.orderBy(*order).limit(n)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of n rows
    joined = best.join(cards, ["type", "id"], "left")
    found = F.col("name").isNotNull()
    return joined.select("type", "id", F.when(found, F.col("rank")).alias("rank"), F.coalesce("name", F.lit("이름 없는 리소스")).alias("name"), F.when(~found, "상세 정보 로드 실패").alias("problem"))


def finite_average(column: str) -> Column:
    """The average of values that are numbers; null if none is."""
    return F.avg(F.when(~F.isnan(column), F.col(column)))


def run_counters(events: DataFrame, most: int = 20) -> DataFrame:
    """user_id (the source), collected, upserted, failed, summary of the first ``most`` errors, status of its run."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    first = events.where("event_type = 'error'").select("user_id", "event_id").withColumn("nth", nth).where(F.col("nth") <= most)
    errors = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("error "), F.col("event_id")).alias("error")))).alias("errors"))
    counts = events.groupBy("user_id").agg(F.count("*").alias("collected"), F.count_if(F.col("event_type") == "purchase").alias("upserted"), F.count_if(F.col("event_type") == "error").alias("failed"))
    texts = F.transform("errors", lambda e: e["error"])
    more = F.when(F.col("failed") > most, F.concat(F.lit("\n... and "), F.col("failed") - most, F.lit(" more"))).otherwise("")
    status = F.when(F.col("failed") == 0, "SUCCESS").when(F.col("upserted") > 0, "PARTIAL_SUCCESS").otherwise("FAILED")
    return counts.join(errors, "user_id", "left").select("user_id", "collected", "upserted", "failed", F.concat(records.error_summary(texts, most), more).alias("summary"), status.alias("status"))


#: The bounds of a rating.
RATING = (1, 5)


def guarded(page: int = 0, size: int = 10, rating: int | None = None, **ids: int) -> None:
    """Raises ValueError for a request that asks for what there cannot be: a negative page, no rows, ratings out of bounds, ids below 1."""
    if page < 0 or size <= 0:
        raise ValueError("page must not be negative, and size must be positive")
    if rating is not None and not RATING[0] <= rating <= RATING[1]:
        raise ValueError(f"rating must be {RATING[0]} to {RATING[1]}")
    for name, value in ids.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def valid_rating(x: Column) -> Column:
    """Whole ratings within the bounds."""
    return F.coalesce(x.between(*RATING) & (x == F.floor(x)), F.lit(False))


def detail(rows: DataFrame, joined: dict[str, tuple[DataFrame, str]], key: str, *columns: str) -> DataFrame:
    """The detail view of rows: ``columns``, and for each name in ``joined`` (frame, column) the distinct values of that column, sorted."""
    out = rows.select(key, *columns)
    for name, (more, column) in joined.items():
        out = out.join(more.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias(name)), key, "left")
    return out
