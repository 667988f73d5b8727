"""Chat sessions and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordering import ordered, ordinal

PAGE_MESSAGES = 10_000


def with_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions left-joined to their messages.

    Written as messages joined to sessions plus the sessions without any: the
    large side is then the probe side, which Spark can split for a session with
    very many messages.
    """
    sent = messages.withColumnsRenamed({"id": "message_id", "created_at": "message_created_at"})
    used = messages.select(F.col("session_id").alias("id")).distinct()
    joined = sent.join(sessions, F.col("session_id") == F.col("id")).drop("session_id")
    return joined.unionByName(sessions.join(used, "id", "left_anti"), allowMissingColumns=True)


def listing(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their message count, zero included.

    Messages are counted before the join, so a session with very many of them
    joins as one row. Order by ``updated_at`` descending to print.
    """
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("id").alias("message_count"))
    return sessions.join(counts, "id", "left").select(
        *sessions.columns, F.coalesce("message_count", F.lit(0)).alias("message_count")
    )


def _positions(rows: DataFrame, most: str, then: str, **options) -> DataFrame:
    """Rows with their 1-based ``position`` by a falling number, in that order."""
    keyed = rows.withColumns({"__all": F.lit(0), "__most": -F.col(most)})
    return (
        ordered(keyed, ["__all"], ["__most", then], {"position": ordinal()}, **options)
        .select(*rows.columns, "position").orderBy("position")
    )


def newest_first(rows: DataFrame, **options) -> DataFrame:
    """Sessions in the order they are listed, with their ``position``."""
    return _positions(rows, "updated_at", "id", **options)


def totals(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: sessions, messages, oldest creation, newest update."""
    rows = sessions.select("created_at", "updated_at", F.lit(True).alias("session")).unionByName(
        messages.select(F.lit(False).alias("session")), allowMissingColumns=True
    )
    return rows.agg(
        F.count_if("session").alias("sessions"),
        F.count_if(~F.col("session")).alias("messages"),
        F.min("created_at").alias("oldest"),
        F.max("updated_at").alias("newest"),
    )


def messages_by_role(messages: DataFrame) -> DataFrame:
    """Messages per role, most frequent first, with the ``position`` of the role."""
    return _positions(messages.groupBy("role").agg(F.count(F.lit(1)).alias("count")), "count", "role", large=False)


def export(
    sessions: DataFrame, messages: DataFrame, *, page_messages: int = PAGE_MESSAGES, **options
) -> DataFrame:
    """Sessions with their messages in order, as nested rows.

    Times become ISO strings, with microseconds where there are any, and JSON text columns
    become variants, which the JSON writer prints as the values they hold. A session
    with more than ``page_messages`` messages continues on further pages.
    """

    def iso(column: str) -> Column:
        micros = F.rint(F.col(column) * F.lit(1e6)).cast("long")
        fraction = F.pmod(micros, F.lit(1_000_000))
        seconds = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(fraction == 0, seconds).otherwise(
            F.concat(seconds, F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
        )

    nested = ["tool_calls", "reasoning"]
    plain = [c for c in messages.columns if c not in ("id", "session_id", "created_at", *nested)]
    message = F.struct(F.col("__pos").alias("position"), *plain, *nested, iso("created_at").alias("created_at"))

    def parsed(m: Column) -> Column:
        values = [F.try_parse_json(F.nullif(m[c], F.lit(""))).alias(c) for c in nested]
        return F.struct(*[m[c].alias(c) for c in ("position", *plain)], *values, m["created_at"].alias("created_at"))

    pages = (
        ordered(messages, ["session_id"], ["created_at", "id"], {"__pos": ordinal()}, **options)
        .withColumn("page", F.floor((F.col("__pos") - 1) / page_messages).cast("int"))
        .groupBy("session_id", "page")
        .agg(F.array_sort(F.collect_list(message)).alias("messages"))
        .withColumn("messages", F.transform("messages", parsed))
    )
    return (
        sessions.join(pages, F.col("id") == F.col("session_id"), "left")
        .select(
            "id",
            F.coalesce("page", F.lit(0)).alias("page"),
            "title",
            "thread_id",
            iso("created_at").alias("created_at"),
            iso("updated_at").alias("updated_at"),
            F.coalesce("messages", F.array()).alias("messages"),
        )
    )


def delete(
    sessions: DataFrame, messages: DataFrame, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions left, messages left, deleted counts per session).

    ``ids`` is a table of session ids; none means all sessions.
    """
    doomed = sessions.select("id") if ids is None else sessions.select("id").join(ids, "id", "left_semi")
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    gone = doomed.join(counts, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("deleted_messages")
    )
    return (
        sessions.join(doomed, "id", "left_anti"),
        messages.join(doomed.select(F.col("id").alias("session_id")), "session_id", "left_anti"),
        gone,
    )
