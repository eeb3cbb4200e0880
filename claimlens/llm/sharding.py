"""Contiguous shards of near-equal bytes, from global prefix sums.

Rows are put in a total order by range partitioning. Each partition's total gives, by a running sum
over partitions, the global byte offset at which it begins; a running sum within the partition then
gives every row its own global offset, without any global sort in one task. The line of bytes is cut
at equal targets, and a row belongs to the shard in which its middle byte lies.

Defined cases: null texts weigh only the row overhead; a null key sorts first; rows that are equal in
all sort columns are ordered arbitrarily but only once, since the order is written down; an empty
table gives an empty result; a cut that falls among such rows splits them in `shard_by_bytes`, which numbers
rows, and leaves them together in `with_shards`, which compares keys; one text larger than a shard can leave neighbours empty; columns that
the caller has besides the key and text don't enter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import crc32_of, shuffle_partitions, written

ROW_OVERHEAD = 16
#: Rows of a range partition: more than the session's partitions are made where a table would exceed it.
PART_ROWS = 4_000_000


def range_count(rows: int, least: int, part_rows: int = PART_ROWS) -> int:
    """`least` partitions, or as many as hold about `part_rows` each."""
    return max(least, -(-rows // part_rows))


def prefix_sums(df: DataFrame, order: list[str], amount: str) -> DataFrame:
    """`df` with `row_index` and `offset` (sum of `amount` before the row) in the global order,
    and `whole` (sum over all rows)."""
    spark = df.sparkSession
    # ranges are drawn from a sample, a pass of its own; what `df` reads, whole texts included, is read once this way
    rows = written(df, "rows")
    parts = range_count(rows.count(), shuffle_partitions(spark))
    dealt = rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    kept = written(dealt.withColumn("part", F.spark_partition_id()), "prefix")
    # one row for each partition
    totals = kept.groupBy("part").agg(F.sum(amount).alias("part_sum"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("base_sum"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_sum").over(everything).alias("whole"),
    )
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        kept.withColumn("row_in_part", F.row_number().over(inside) - 1)
        .withColumn("sum_in_part", F.coalesce(F.sum(amount).over(running), F.lit(0)))
        .join(F.broadcast(bases), "part")
        .withColumn("row_index", (F.col("base_rows") + F.col("row_in_part")).cast("long"))
        .withColumn("offset", (F.col("base_sum") + F.col("sum_in_part")).cast("long"))
        .drop("part", "base_sum", "base_rows", "row_in_part", "sum_in_part")
    )


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), crc32_of(text).alias("text_crc32")
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (place in the shard, gapless from 0) of every row.

    Rows that agree in the whole sort key may lie on both sides of a cut.
    """
    placed = prefix_sums(_slim(docs), ["doc_id", "text_crc32", "size"], "size")
    middle = F.expr(f"(2 * offset + size) * {n_shards} div (2 * whole)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    # n_shards rows
    first = placed.groupBy("shard").agg(F.min("row_index").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_index") - F.col("first_row")).alias("slot")
    )


def shard_bounds(docs: DataFrame, n_shards: int) -> list:
    """The sort key of each shard's first row, in order: at most `n_shards` rows on the driver."""
    placed = shard_by_bytes(docs, n_shards)
    first = placed.filter("slot = 0").select("shard", "doc_id", "text_crc32", "size")
    return sorted(first.collect(), key=lambda r: r["shard"])


def with_shards(docs: DataFrame, n_shards: int = 40, name: str = "shard") -> DataFrame:
    """All columns of `docs` and the shard of each row, as column `name` (it replaces one of that name).

    The cuts are n_shards sort keys, so that each row finds its shard by comparing with them and no
    text is shuffled. Rows that agree in the whole sort key stay together, also where shard_by_bytes splits them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(
        F.col("doc_id").alias("doc_id"),
        crc32_of(text).alias("text_crc32"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
    )
    shard = F.lit(0)
    kind = docs.schema["doc_id"].dataType
    for row in shard_bounds(docs, n_shards):
        cut = F.struct(
            F.lit(row["doc_id"]).cast(kind).alias("doc_id"),
            F.lit(row["text_crc32"]).cast("long").alias("text_crc32"),
            F.lit(row["size"]).cast("long").alias("size"),
        )
        shard = F.when(own >= cut, row["shard"]).otherwise(shard)
    return docs.withColumn(name, shard.cast("int"))
