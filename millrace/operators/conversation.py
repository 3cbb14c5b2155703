"""Windows over the turns of conversations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text


def within_budget(turns: DataFrame, budget: int, each: int) -> DataFrame:
    """Turns newest first, each cut to ``each`` characters, until ``budget`` is used up; the newest is always there. Column ``given``."""
    size = F.least(F.char_length("text"), F.lit(each))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.lit(budget) - before).cast("int")
    return turns.withColumn("given", F.substring(F.substring(F.col("text"), F.lit(1), F.lit(each)), F.lit(1), room))


def last_turns(turns: DataFrame, n: int, each: int) -> DataFrame:
    """The last n turns of each conversation as one prompt, oldest first."""
    newest = turns.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where(F.col("_n") <= n)
    line = F.concat(F.upper("role"), F.lit(": "), text.clip(F.coalesce(F.col("text"), F.lit("")), each))
    return newest.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def next_turn(turns: DataFrame) -> DataFrame:
    """The order of the next user turn: odd, after the last one."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return last.withColumn("next_turn", F.when(F.col("last_turn") % 2 == 0, F.col("last_turn") + 1).otherwise(F.col("last_turn") + 2))


def title(x, n: int = 30):
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)
