"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's words lie in buckets, as many as the rows call for, and in each bucket its documents stand end to
end in a seeded order, cut into blocks of equal length. Blocks are apportioned to sources by highest
quotients target / (2k + 1), then each source's blocks to its buckets in the same way by their words;
the integer quota of a bucket takes whole passes over its line and then its first blocks. All of it
is arithmetic on one row per (source, bucket), so the hot source costs no more than another. A bucket holds
BUCKET_ROWS rows of one source at most, about, however many the table has. The only steps in one task work on
one row a source, and on one row a bucket of a source.

Only seats near a source's exact share can be in doubt: a divisor method changes a share x by at most
n/2 seats spread over the n parties in proportion, so all seats below x - n x / (2 X) - 2 are granted
outright and about three seats a party are ranked.

Defined cases: null texts have no words and take nothing; null is a source of its own, last in order;
no words at all give targets of 0; repeated rows each count; a source or bucket without words gets no
block. Columns besides doc_id, text and source don't enter, whatever their names.

Whole documents: a bucket's quota cuts one document, which goes or stays whole; the words that this adds
or leaves are carried to the source's next bucket, so that they don't add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import bounded, word_count, written

REPEATS = 3
#: Buckets of a source: at least so many, and doubled until a bucket has about so many rows at most.
BUCKETS = 128
BUCKET_ROWS = 65_536
BLOCK_WORDS = 4096


def apportion(parties: DataFrame, group: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """`parties` with `quota`: the `seats` of each group dealt by highest quotients of `weight`.

    Ties go to the party that comes first by `order`, then to the lower seat.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.col(seats) * F.col(weight) / F.col("_weights")
    doubt = F.col("_n") * F.col(weight) / (2 * F.col("_weights")) + 2
    based = (
        parties.filter(F.col(weight) > 0)
        .withColumn("_weights", F.sum(weight).over(whole).cast("double"))
        .withColumn("_n", F.count("*").over(whole))
        .withColumn("_low", F.greatest(F.lit(0), F.floor(share - doubt)).cast("long"))
        .withColumn("_high", F.ceil(share + doubt).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    )
    seat = based.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    ranked = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = ranked.orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), *order, "_k")
    won = seat.withColumn("_rank", F.row_number().over(ranked)).groupBy(*group, *order).agg(
        (F.first("_low") + F.count_if(F.col("_rank") <= F.col("_open"))).alias("quota")
    )
    keys = [*group, *order]
    return parties.join(won, keys, "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def targets(sources: DataFrame) -> DataFrame:
    """skey, source, source_size -> also `place` (rank by code point, null last) and `target`.

    Weights 1, 2, 3 repeat by place. Capped sources are a prefix in the order of cap / weight, so the
    common level is found from running sums instead of repeated resharing.
    """
    every = Window.partitionBy(F.lit(0))
    by_place = every.orderBy(F.col("source").asc_nulls_last())
    filled = every.orderBy("ratio", "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        sources.withColumn("place", F.row_number().over(by_place))
        .withColumn("weight", (F.col("place") - 1) % 3 + 1)
        .withColumn("cap", REPEATS * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("turn", F.row_number().over(filled))
        .withColumn("level", level)
        .withColumn("opens", F.min(F.when(F.col("ratio") > F.col("level"), F.col("turn"))).over(every))
        .withColumn("common", F.max(F.when(F.col("turn") == F.col("opens"), F.col("level"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("opens").isNull() | (F.col("turn") < F.col("opens")), F.col("cap").cast("double")).otherwise(
                F.col("common") * F.col("weight")
            ),
        )
        .select("skey", "source", "source_size", "place", "total", "target")
    )


def source_key(source: Column) -> Column:
    """A key that is never null and tells null from every string."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def sized_documents(docs: DataFrame, seed: int) -> DataFrame:
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        "doc_id",
        "source",
        source_key(F.col("source")).alias("skey"),
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(draw, 1, 8), 16, 10).cast("long").alias("lot"),
        F.substring(draw, 9, 20).alias("draw"),
    )


def bucket_count(rows: int, least: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> int:
    """`least`, doubled until even a source with all rows has about `bucket_rows` in a bucket."""
    buckets = least
    while rows > buckets * bucket_rows:
        buckets *= 2
    return buckets


def _laid(docs: DataFrame, seed: int, least_buckets: int, block_words: int) -> DataFrame:
    """Every row of `docs` on its bucket's line: where it starts, and the whole passes and the rest of the
    words that the bucket's quota takes."""
    sized = written(sized_documents(docs, seed), "sized")
    buckets = bucket_count(sized.count(), least_buckets)
    sized = sized.withColumn("bucket", F.pmod("lot", F.lit(buckets)).cast("int")).drop("lot")
    lines = sized.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("line"))
    sources = lines.groupBy("skey").agg(F.first("source").alias("source"), F.sum("line").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(least / (100 * buckets)))).cast("long")
    planned = (
        targets(sources)
        .withColumn("block", F.coalesce(block, F.lit(1)))
        .withColumn("blocks", F.round(F.col("total") / F.col("block")).cast("long"))
    )
    quotas = apportion(planned, [], ["place"], "target", "blocks").withColumnRenamed("quota", "source_quota")
    quotas = quotas.select("skey", "source_size", "target", "block", "source_quota")
    shares = lines.select("skey", "bucket", "line").join(quotas, "skey")
    dealt = apportion(shares, ["skey"], ["bucket"], "line", "source_quota").select(
        "skey",
        "bucket",
        "line",
        "source_size",
        "target",
        "block",
        F.least(F.col("quota") * F.col("block"), REPEATS * F.col("line")).alias("words"),
    )
    along = Window.partitionBy("skey", "bucket").orderBy("draw", "doc_id", "size")
    start = F.coalesce(F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("line") > 0, F.expr("words div line")).otherwise(0)
    return (
        sized.withColumn("start", start)
        .join(dealt, ["skey", "bucket"])
        .withColumn("passes", passes)
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("line"))
    )


def mix_sources(docs: DataFrame, *, seed: int = 17, buckets: int = BUCKETS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, block_words of every row of `docs`.

    A block is at most `block_words` words and at most a hundredth of the smallest target's part in a
    bucket, so that rounding to whole blocks stays below one per cent of any target.
    """
    first = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    taken = (F.col("passes") * F.col("size") + first).cast("long").alias("taken")
    laid = _laid(docs, seed, buckets, block_words)
    return laid.select("doc_id", "size", "source_size", "target", taken, F.col("block").alias("block_words"))


def _stays(laid: DataFrame) -> DataFrame:
    """skey, bucket of the buckets whose cut document goes once more.

    A bucket's rest cuts one document at most. Along a source's buckets the words still owed are carried
    on: the cut document goes if that leaves fewer owed, in absolute value, than leaving it. What is owed
    in the end is at most half of the longest cut document. An array has one element a bucket at most.
    """
    cut = laid.filter((F.col("start") < F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size")))
    each = F.struct("bucket", (F.col("rest") - F.col("start")).alias("part"), "size")
    begin = F.struct(F.lit(0).cast("long").alias("owed"), F.array().cast("array<int>").alias("goes"))

    def step(state: Column, x: Column) -> Column:
        owed = state["owed"] + x["part"]
        goes = 2 * owed >= x["size"]
        return F.struct(
            F.when(goes, owed - x["size"]).otherwise(owed).alias("owed"),
            F.when(goes, F.concat(state["goes"], F.array(x["bucket"]))).otherwise(state["goes"]).alias("goes"),
        )

    carried = F.aggregate(F.sort_array(F.collect_list(each)), begin, step, lambda state: state["goes"])
    return cut.groupBy("skey").agg(carried.alias("goes")).select("skey", F.explode("goes").alias("bucket"))


def mixed_documents(
    docs: DataFrame, *, seed: int = 17, buckets: int = BUCKETS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """All columns of `docs`, each row as often as the mix takes it, in whole documents: a source's words
    are those of the mix to within half of its longest document."""
    laid = written(_laid(docs, seed, buckets, block_words).drop("source"), "laid")
    stays = _stays(laid).withColumn("more", F.lit(1))
    once = F.when(F.col("start") + F.col("size") <= F.col("rest"), 1).when(F.col("start") < F.col("rest"), F.coalesce("more", F.lit(0)))
    dealt = laid.filter("size > 0").join(stays, ["skey", "bucket"], "left").withColumn("copies", F.col("passes") + F.coalesce(once, F.lit(0)))
    units = dealt.groupBy(F.col("doc_id").alias("mixed_id"), "skey", F.col("size").alias("mixed_size")).agg(
        F.sum("copies").cast("int").alias("copies"), F.count("*").cast("int").alias("alike")
    )
    wanted = written(units.filter("copies > 0"), "copies")
    # the row travels as one struct, so that no column of `docs` can clash with the repetition
    row = F.struct(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
    same = F.col("d.doc_id").eqNullSafe(F.col("w.mixed_id"))
    repeated = not laid.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeated:
        same = same & (source_key(F.col("d.source")) == F.col("w.skey")) & (word_count(F.col("d.text")) == F.col("w.mixed_size"))
    joined = docs.alias("d").join(bounded(wanted).alias("w"), same)
    dealt_rows = joined.select(row.alias("row"), "w.mixed_id", "w.skey", "w.mixed_size", "w.copies", "w.alike")
    if repeated:
        # rows alike in id, source and size share their copies; only those are put in an order
        alike = Window.partitionBy("mixed_id", "skey", "mixed_size").orderBy(F.xxhash64("row.text"))
        share = F.expr("copies div alike + if(turn <= copies % alike, 1, 0)").cast("int")
        shared = dealt_rows.filter("alike > 1").withColumn("turn", F.row_number().over(alike)).withColumn("copies", share)
        dealt_rows = dealt_rows.filter("alike = 1").union(shared.filter("copies > 0").drop("turn"))
    return dealt_rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
