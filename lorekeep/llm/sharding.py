"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put into one global order (a hash of the text, then the id, so that equal texts lie side by side) by a
range partitioning of narrow rows. Each partition's total is summed first; a partition's running sum
plus the totals before it is the row's global prefix. Shards end at equal targets of bytes. A target that falls into a
group of equal texts moves to the nearer end of the group, so that the group stays in one shard; only a group
of more than ``1 / WHOLE_GROUPS`` of a shard is parted, at the row where the target falls: the law of near-equal
bytes comes before groups. The text itself is never shuffled: of the plan a table with text needs only the first
key of each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 8
#: A group of equal texts of up to 1 / WHOLE_GROUPS of a shard's bytes stays in one shard.
WHOLE_GROUPS = 16


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes plus 1 (a null text: 1)."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def order_key(text: str = "text") -> Column:
    """Sixty bits of the text's MD5 (a null text as an empty one)."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _cuts(placed: DataFrame, total: int, shards: int) -> list[float]:
    """Where shards 1, 2, ... begin, in bytes of the global order. Of the rows only those at a target, and their groups' ends,
    reach the driver."""
    targets = [k * total / shards for k in range(1, shards)]
    at = [(F.col("before") <= t) & (F.col("before") + F.col("size") > t) for t in targets]
    keys = [r[0] for r in placed.where(F.exists(F.array(*at), lambda x: x)).select("order_key").distinct().collect()] if targets else []
    ends = placed.where(F.col("order_key").isin(keys)).groupBy("order_key").agg(F.min("before"), F.max(F.col("before") + F.col("size"))).collect()
    cuts = []
    for t in targets:
        whole = [(a, b) for _, a, b in ends if a <= t < b and (b - a) * shards * WHOLE_GROUPS <= total]
        cuts.append(float(min(whole[0], key=lambda e: (abs(e - t), e))) if whole else t)
    return cuts


def plan_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, order_key, shard, slot for every row of ``docs`` (doc_id, text).

    Shards are numbered in the global order; a row belongs to the shard that its middle falls into. Slot counts a shard's
    rows from 0 in that order. A null text has the bytes, checksum and key of an empty one; a null
    doc_id is ordered first among equal texts; repeated rows are rows of their own. An empty table
    gives an empty table; fewer rows than shards leave shards empty."""
    narrow = docs.select("doc_id", row_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), order_key().alias("order_key"))
    dealt = materialize(narrow.repartitionByRange("order_key", "doc_id").withColumn("part", F.spark_partition_id()), "shard-order")
    # a row per partition: bounded by the number of partitions, not by rows
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("part").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"upto": F.sum("size").over(within), "row": F.count("*").over(within)}).join(F.broadcast(offsets), "part")
    placed = placed.select("doc_id", "size", "text_crc32", "order_key", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("before"), (F.col("rows_before") + F.col("row") - 1).alias("row"))
    placed = materialize(placed, "shard-places")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    middle = F.col("before") + F.col("size") / 2
    shard = sum(((middle >= c).cast("int") for c in _cuts(placed, total, shards)), F.lit(0))
    placed = placed.withColumn("shard", shard)
    starts = placed.groupBy("shard").agg(F.min("row").alias("shard_start"))
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "order_key", "shard", (F.col("row") - F.col("shard_start")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with a column shard (replaced if there), by the first (order_key, doc_id) of each shard.
    Rows that repeat a document wholly stay in one shard."""
    plan = plan_shards(docs, shards)
    cuts = plan.groupBy("shard").agg(F.min(F.struct("order_key", F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("cut")).where("shard > 0").orderBy("shard").collect()
    key, named, shard = order_key(), F.col("doc_id").isNotNull(), F.lit(0)
    for r in cuts:  # at most shards - 1 rows
        k, n, d = r["cut"]
        later = (key > k) | ((key == k) & ((named > F.lit(n)) | ((named == F.lit(n)) & (F.col("doc_id").eqNullSafe(F.lit(d)) | F.coalesce(F.col("doc_id") > F.lit(d), F.lit(False))))))
        shard = F.when(later, F.lit(r["shard"])).otherwise(shard)
    return docs.drop("shard").withColumn("shard", shard.cast("int"))


def op9_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document, under the law of near-equal bytes."""
    plan = plan_shards(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# the checksum of a text is folded from its bytes by the usual table, which is made from the polynomial
OP9_SQL = r"""
with recursive tb(i, k, c) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from tb where k < 8),
tab as (select list(c order by i) as t from tb where k = 8),
d as (select doc_id, coalesce(text, '') as text, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) as k from documents),
o as (select *, cast(sum(size) over w - size as bigint) as before, row_number() over w - 1 as row, sum(size) over () as total from d window w as (order by k, doc_id nulls first rows between unbounded preceding and current row)),
g as (select k, min(before) as a, max(before + size) as b, max(total) as total from o group by k),
t as (select n, n * (select max(total) from o) / 8.0::double as t from range(1, 8) r(n)),
c as (select t.n, coalesce(max(case when abs(g.a - t.t) <= abs(g.b - t.t) then g.a else g.b end)::double, max(t.t)) as cut from t left join g on g.a <= t.t and t.t < g.b and (g.b - g.a) * 128 <= g.total group by t.n),
s as (select o.*, (select count(*) from c where o.before + o.size / 2.0::double >= c.cut) as shard from o)
select doc_id, size, xor(list_reduce(list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g'), ','), lambda x: coalesce(try_cast('0x' || x as bigint), 4294967296)),
    lambda a, b: case when b = 4294967296 then a else xor(t[xor(a, b) % 256 + 1], a >> 8) end, 4294967295), 4294967295) as text_crc32,
  'bytes' as law, cast(shard as int) as shard, row - min(row) over (partition by shard) as slot, cast(null as int) as grown_shard from s, tab
"""
