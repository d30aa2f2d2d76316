"""Chat history: tails, transcripts, model contents and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tail(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each conversation; none for n = 0."""
    if n <= 0:
        return turns.where(F.lit(False))
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def tail_array(history: F.Column, n: int) -> F.Column:
    """The last n elements of an array column."""
    if n <= 0:
        return F.filter(history, lambda x: F.lit(False))
    return F.when(F.size(history) <= n, history).otherwise(F.slice(history, F.size(history) - n + 1, n))


def transcript(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One text per conversation: lines of the user and (all others) the assistant, in order."""
    who = F.when(F.col("role") == "user", "Usuario: ").otherwise("Asistente: ")
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.concat(who, F.coalesce("text", F.lit(""))).alias("line")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("transcript"))


def user_turn(query: F.Column, history: F.Column) -> F.Column:
    """The query alone, or behind the labelled transcript if there is one."""
    return F.when(F.coalesce(history, F.lit("")) == "", query).otherwise(F.concat(F.lit("Conversación previa:\n"), history, F.lit("\n\nConsulta actual: "), query))


def to_contents(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, instruction (the last system turn or null) and contents (role model or user, text) in order."""
    role = F.when(F.col("role") == "assistant", "model").otherwise("user")
    system = F.col("role") == "system"
    item = F.struct(order, role.alias("role"), F.col("text"))
    rows = turns.groupBy(key).agg(F.max_by(F.when(system, F.col("text")), F.when(system, F.col(order))).alias("instruction"), F.array_sort(F.collect_list(F.when(~system, item))).alias("x"))
    return rows.select(key, "instruction", F.transform("x", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("contents"))


def session_segments(events: DataFrame, key: str, order: list[str], setting: str) -> DataFrame:
    """segment: counts from 0 the changes of a setting within a session; history doesn't reach over a change."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((F.col(setting) != F.lag(setting).over(w)).cast("int"), F.lit(0))
    return events.withColumn("__c", changed).withColumn("segment", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__c")
