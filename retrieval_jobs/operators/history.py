"""Chat history tables (_id, session_id, role, text, rewritten_query, item_names, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrieval_jobs.functions.text import history_line


def recent_messages(history: DataFrame, n: int = 10, order: str = "last", session: str = "session_id") -> DataFrame:
    """The last (or ``order="first"``: first) ``n`` messages of each session, numbered by ascending time in ``pos``."""
    time = F.desc("ts") if order == "last" else F.asc("ts")
    rows = history.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(time, F.col("_id")))).where(F.col("_n") <= n).drop("_n")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(session).orderBy("ts", "_id")))


def format_history(messages: DataFrame, labels: dict[str, str] | None = None, session: str = "session_id") -> DataFrame:
    """(session, history): ``role: text`` lines in order; with labels, other roles and blank texts drop."""
    rows = messages.withColumn("_line", history_line(F.col("role"), F.col("text"), labels)).where("_line is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_line"))), lambda x: x["_line"])
    return rows.groupBy(session).agg(F.array_join(lines, "\n").alias("history"))


def save_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """Messages without an id are added under a hash of their content; with a known id they replace that message's fields; an unknown id adds nothing."""
    columns = history.columns
    fresh = new.where("_id is null").withColumn("_id", F.sha2(F.concat_ws("|", "session_id", "role", "text", F.col("ts").cast("string")), 256))
    named = new.where("_id is not null")
    known = named.join(history.select("_id"), "_id", "left_semi")
    kept = history.join(known.select("_id"), "_id", "left_anti")
    return kept.unionByName(known.select(*columns)).unionByName(fresh.select(*columns))


def delete_sessions(history: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The history without the sessions, and (session_id, removed) counts."""
    gone = history.join(sessions.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("removed"))
    return history.join(sessions.select("session_id").distinct(), "session_id", "left_anti"), gone


def backfill_item_names(history: DataFrame, updates: DataFrame) -> DataFrame:
    """Item names set on the listed messages (updates: _id, items) that have none; ``changed`` marks them."""
    empty = F.col("item_names").isNull() | (F.size("item_names") == 0)
    rows = history.join(updates.select("_id", "items").dropDuplicates(["_id"]), "_id", "left").withColumn("changed", F.col("items").isNotNull() & empty)
    return rows.withColumn("item_names", F.when(F.col("changed"), F.col("items")).otherwise(F.col("item_names"))).drop("items")
