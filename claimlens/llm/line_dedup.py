"""Line dedup: later copies of repeated line runs, by a suffix array over line-ID sequences.

A document is the sequence of its lines that have a word; a line's ID is a 128-bit hash of its text.
The suffix array of all sequences is grown by distributed prefix doubling: after round h a suffix's
rank is the place where its interval of suffixes with the same first 2^h lines begins, found by a
distributed prefix sum over interval sizes. Two neighbours in one interval have a longest common
prefix of 2^h lines at least; a suffix alone in its interval repeats nowhere at that length and
leaves, so a round only touches what still repeats. Runs are measured in words, a line has one at
least, so doubling ends when 2^h reaches `min_words`, however long the copies are.

For any length L between powers of two the interval of the first L lines, that is of the suffixes whose
longest common prefixes have L lines at least, is that of the pair (rank of the first 2^h, rank of the last
2^h). A run of at least `min_words` words that also stands earlier in the corpus (by doc_id, then line) is
covered exactly by its shortest qualifying pieces: from each line forwards and to each line backwards. The
lines of all pieces whose interval holds an earlier member are removed. A run of the result is the union of
neighbouring pieces; where documents interleave passages of several earlier ones, its pieces may have their
first copies in different places.

Defined cases: null and empty texts have no lines; rows with the same doc_id and text count once;
rows with the same doc_id and another text are told apart by a hash of it; a run that overlaps its own
earlier copy is removed from its second occurrence on; a null doc_id sorts first; columns besides
doc_id and text don't enter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import WORD, word_count, written
from claimlens.llm.sharding import prefix_sums

MIN_WORDS = 50


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_hash, pos (place among the document's lines with words), line_no, words, a, b."""
    lines = F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("no"))),
        lambda s: s["line"].rlike(WORD),
    )
    exploded = docs.select(
        "doc_id", F.xxhash64("text").alias("doc_hash"), F.posexplode(lines).alias("pos", "line")
    )
    return exploded.select(
        "doc_id",
        "doc_hash",
        "pos",
        F.col("line.no").alias("line_no"),
        word_count(F.col("line.line")).alias("words"),
        F.xxhash64("line.line").alias("a"),
        F.xxhash64(F.lit("second"), "line.line").alias("b"),
    )


def _repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """The lines whose ID occurs more than once, each occurrence once.

    Here and below a join has a written table on either side: a line may have a third of all rows, and
    adaptive execution can split its partition only then.
    """
    lines = written(document_lines(docs), "lines")
    often = written(lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "often")
    return lines.join(often, ["a", "b"]).dropDuplicates(["doc_id", "doc_hash", "pos"])


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` of a suffix table with `rank`, the beginning of their interval in the sorted order of
    `keys`; suffixes alone in their interval leave."""
    # counted and joined, so made once
    rows = written(rows, "suffixes")
    intervals = rows.groupBy(*keys).agg(F.count("*").alias("members")).filter("members > 1")
    placed = written(prefix_sums(intervals, keys, "members").select(*keys, F.col("offset").alias("rank")), "placed")
    return rows.join(placed, keys)


def _at(column: str, by: int):
    """The value of `column` at the document's line `by` places on; null where that has left."""
    same = Window.partitionBy("doc_id", "doc_hash").orderBy("pos").rangeBetween(by, by)
    return F.max(column).over(same)


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, doc_hash, pos, line_no, words, r0, r1, ...: rank of the suffix at pos among the first
    2^h lines, null from where it no longer repeats. Only lines that repeat have a row."""
    levels = written(_ranked(_repeated(docs, min_words), ["a", "b"]).withColumnRenamed("rank", "r0").drop("a", "b"), "ranks")
    h = 0
    while 2 << h <= min_words:
        pairs = levels.withColumn("_next", _at(f"r{h}", 1 << h)).filter(f"r{h} is not null and _next is not null")
        ranked = _ranked(pairs.select("doc_id", "doc_hash", "pos", f"r{h}", "_next"), [f"r{h}", "_next"])
        key = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "doc_hash", "pos")]
        joined = levels.alias("x").join(ranked.alias("y"), key, "left")
        levels = written(joined.select("x.*", F.col("y.rank").alias(f"r{h + 1}")), "ranks")
        h += 1
    return levels


def removed_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each maximal run of removed lines: doc_id, first_line and last_line (0-based among
    \\n-split lines), n_lines (with words), n_words."""
    ranks = suffix_ranks(docs, min_words)
    levels = sum(c.startswith("r") and c[1:].isdigit() for c in ranks.columns)
    doc = Window.partitionBy("doc_id", "doc_hash").orderBy("pos")
    # lines of a document that repeat without a gap; pieces can't reach beyond
    stretch = ranks.withColumn("gap", F.col("pos") - F.row_number().over(doc))
    inside = Window.partitionBy("doc_id", "doc_hash", "gap").orderBy("pos")
    total = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    summed = stretch.withColumn("upto", total)
    # every line starts min_words lines at most before its shortest piece ends
    ahead = F.collect_list("upto").over(inside.rowsBetween(0, min_words - 1))
    behind = F.collect_list(F.struct("pos", (F.col("upto") - F.col("words")).alias("start"))).over(
        inside.rowsBetween(-(min_words - 1), 0)
    )
    reach = F.size(F.filter("ahead", lambda u: u - (F.col("upto") - F.col("words")) < min_words)) + 1
    back = F.size(F.filter("behind", lambda s: F.col("upto") - s["start"] >= min_words))
    pieces = (
        summed.withColumn("ahead", ahead)
        .withColumn("behind", behind)
        .withColumn("forwards", F.when(F.element_at("ahead", -1) - F.col("upto") + F.col("words") >= min_words, reach))
        .withColumn("backwards", F.when(back > 0, F.size("behind") - back + 1))
        .drop("ahead", "behind")
    )
    ranked = pieces.select("doc_id", "doc_hash", "pos", "forwards", "backwards", *[f"r{i}" for i in range(levels)])
    both = ranked.select(
        "doc_id",
        "doc_hash",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("forwards").isNotNull(), F.struct(F.col("pos").alias("first"), F.col("forwards").alias("n"))),
                    F.when(
                        F.col("backwards").isNotNull(),
                        F.struct((F.col("pos") - F.col("backwards") + 1).alias("first"), F.col("backwards").alias("n")),
                    ),
                )
            )
        ).alias("piece"),
    ).select("doc_id", "doc_hash", "piece.*").distinct()
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    both = both.withColumn("h", level).withColumn("tail", F.expr("first + n - shiftleft(1, h)"))
    rank_at = ranks.select(
        "doc_id", "doc_hash", "pos", F.array(*[F.col(f"r{i}") for i in range(levels)]).alias("ranks")
    )

    def looked_up(df: DataFrame, at: str, name: str) -> DataFrame:
        key = [F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), F.col("x.doc_hash") == F.col("y.doc_hash"), F.col(f"x.{at}") == F.col("y.pos")]
        found = F.get(F.col("y.ranks"), F.col("x.h")).alias(name)
        return df.alias("x").join(rank_at.alias("y"), key).select("x.*", found).filter(F.col(name).isNotNull())

    classed = written(looked_up(looked_up(both, "first", "head_rank"), "tail", "tail_rank"), "pieces")
    place = F.struct("doc_id", "doc_hash", "first")
    firsts = written(classed.groupBy("n", "head_rank", "tail_rank").agg(F.min(place).alias("origin")), "firsts")
    later = (
        classed.join(firsts, ["n", "head_rank", "tail_rank"])
        .filter(~F.col("origin").eqNullSafe(place))
        .select("doc_id", "doc_hash", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("pos"))
        .distinct()
    )
    key = [F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), F.col("x.doc_hash") == F.col("y.doc_hash"), F.col("x.pos") == F.col("y.pos")]
    gone = ranks.alias("x").join(later.alias("y"), key, "left_semi").select("doc_id", "doc_hash", "pos", "line_no", "words")
    runs = gone.withColumn("run", F.col("pos") - F.row_number().over(doc)).groupBy("doc_id", "doc_hash", "run")
    return runs.agg(
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.count("*").alias("n_lines"),
        F.sum("words").alias("n_words"),
    ).drop("run")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs` with the removed runs cut out of `text`; other lines keep their order."""
    runs = removed_runs(docs, min_words).groupBy("doc_id", "doc_hash").agg(
        F.collect_list(F.struct("first_line", "last_line")).alias("cut_runs")
    )
    key = [F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), F.xxhash64("d.text") == F.col("r.doc_hash")]
    joined = docs.alias("d").join(runs.alias("r"), key, "left")
    lines = F.split("d.text", "\n", -1)
    stay = F.filter(
        lines, lambda line, i: ~F.exists(F.col("r.cut_runs"), lambda c: (c["first_line"] <= i) & (i <= c["last_line"]) & line.rlike(WORD))
    )
    text = F.when(F.col("r.cut_runs").isNull(), F.col("d.text")).otherwise(F.array_join(stay, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"d.{c}") for c in docs.columns])
