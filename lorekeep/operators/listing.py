"""Point reads, lists, pages and counts over the memories table."""

from __future__ import annotations

import base64
import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import visible

ORDERS = {"recent": ["created_at"], "importance": ["importance", "created_at"], "most_accessed": ["access_count", "created_at"], "last_accessed": ["last_accessed_at", "created_at"]}


def order_by(sort: str) -> list[Column]:
    """Every order ends with the id, descending, so that ties have one order."""
    return [F.col(c).desc() for c in [*ORDERS[sort], "id"]]


def get(memories: DataFrame, id_: str) -> DataFrame:
    return memories.where((F.col("id") == id_) & visible())


def get_many(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: a DataFrame with a column id, of any size."""
    return memories.join(ids.select("id"), "id", "left_semi")


def encode_cursor(created_at: dt.datetime, id_: str) -> str:
    return base64.urlsafe_b64encode(f"{created_at.isoformat()}\0{id_}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[dt.datetime, str]:
    at, _, id_ = base64.urlsafe_b64decode(cursor.encode()).decode().partition("\0")
    return dt.datetime.fromisoformat(at), id_


def listed(memories: DataFrame, where: Column | None = None, sort: str = "recent", cursor: str | None = None, offset: int = 0, limit: int | None = 100) -> DataFrame:
    """The visible rows in order; a cursor (only of sort ``recent``) continues after its row. limit None: all."""
    rows = memories.where(visible() & (F.lit(True) if where is None else where))
    if cursor:
        at, id_ = decode_cursor(cursor)
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < id_)))
    rows = rows.orderBy(*order_by(sort)).offset(offset)
    return rows if limit is None else rows.limit(limit)


def page(memories: DataFrame, limit: int = 100, cursor: str | None = None, where: Column | None = None) -> tuple[list, str | None]:
    """A page of 1 to 100 rows and the cursor of the next one (None at the end); reads a row more than it returns."""
    limit = min(max(limit, 1), 100)
    rows = listed(memories, where, cursor=cursor, limit=limit + 1).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, encode_cursor(rows[-1]["created_at"], rows[-1]["id"]) if more else None


def ranked_per(df: DataFrame, key: str, order: list[Column], least: int) -> DataFrame:
    """The first ``least`` rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= least)


def seeds(memories: DataFrame, threshold: float = 0.8, limit: int = 20) -> DataFrame:
    return memories.where(visible() & (F.col("importance") >= threshold)).orderBy(F.desc("importance"), F.desc("updated_at"), F.desc("id")).limit(limit)


def record_access(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Folds an access log (id, at) into last_accessed_at and access_count."""
    seen = accesses.groupBy("id").agg(F.max("at").alias("__at"), F.count("*").alias("__n"))
    joined = memories.join(seen, "id", "left")
    return joined.withColumns({"last_accessed_at": F.greatest("last_accessed_at", "__at"), "access_count": F.col("access_count") + F.coalesce("__n", F.lit(0))}).drop("__at", "__n")


def subgraph(memories: DataFrame, edges: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The most recent visible memories and the edges that have both ends among them."""
    nodes = listed(memories, limit=limit)
    ids = nodes.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, inner
