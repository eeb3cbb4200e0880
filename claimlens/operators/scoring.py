"""From positions with probabilities to one row of sufficient statistics for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.stats import STATISTICS, position_statistics, softmax

#: Reduced column -> statistic whose mean it is. The collision probability is kept but never reduced.
REDUCED = {
    "ce_mean": "ce",
    "entropy_mean": "entropy",
    "collision_entropy_mean": "collision_entropy",
    "delta_mean": "delta",
    "swap_llr_mean": "swap_llr",
    "expected_drift_mean": "expected_drift",
    "expected_dispersion_mean": "expected_dispersion",
    "top_mismatch_rate": "top_mismatch",
}
POSITION_LISTS = ("target_ids", "top_ids", "top_alternative_ids", *(f"{s}_by_piece" for s in STATISTICS))


def score_positions(positions: DataFrame, probabilities: str = "probabilities", target: str = "target_id") -> DataFrame:
    """Add the statistics of every position; NULL where its distribution or target is invalid."""
    stats = position_statistics(F.col(probabilities), F.col(target))
    keep = [c for c in positions.columns if c not in (probabilities, target)]
    return positions.select(*keep, stats.alias("stats")).select(*keep, "stats.*")


def score_logits(positions: DataFrame, logits: str = "logits", target: str = "target_id") -> DataFrame:
    return score_positions(positions.withColumn("probabilities", softmax(F.col(logits))).drop(logits), target=target)


def reduce_positions(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted means over the positions of a request, and how many they are."""
    means = [F.avg(source).alias(name) for name, source in REDUCED.items()]
    return scored.groupBy(*keys).agg(F.count("*").alias("n_masked_pieces"), *means)


def statistics_as_lists(scored: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """One row for each request with every statistic as a list in position order."""
    fields = ["target_id", "top_id", "top_alternative_id", *STATISTICS]
    ordered = F.array_sort(F.collect_list(F.struct(position, *fields)))
    listed = scored.groupBy(*keys).agg(ordered.alias("all"))
    named = [F.col(f"all.{f}").alias(name) for f, name in zip(fields, POSITION_LISTS, strict=True)]
    at = F.col(f"all.{position}").cast("array<int>").alias("masked_positions")
    return listed.select(*keys, at, *named)


def reduce_lists(rows: DataFrame) -> DataFrame:
    """Add n_masked_pieces and the reduced means to rows that carry lists."""
    n = F.size("target_ids")
    means = {name: F.aggregate(f"{source}_by_piece", F.lit(0.0), lambda a, x: a + x) / n for name, source in REDUCED.items()}
    return rows.withColumns({"n_masked_pieces": n, **means})


def result_rows(lists: DataFrame, metadata: DataFrame) -> DataFrame:
    """Physical statistics joined with the logical columns of their requests, by work_id."""
    return reduce_lists(lists).join(metadata, "work_id")


def attach_marginals(requests: DataFrame, marginals: DataFrame) -> DataFrame:
    """One row for each masked position of (request_id, target_ids, ...), with its probabilities.

    Joined by key, so neither side's order matters. `mismatch` is true where the position has no
    marginal, or one of another target; marginals of no request are left out.
    """
    keep = [c for c in requests.columns if c not in ("target_ids", "position")]
    positions = requests.select(*keep, F.posexplode("target_ids").alias("position", "target_id"))
    given = marginals.select("request_id", "position", F.col("target_id").alias("given_target"), "probabilities")
    joined = positions.join(given, ["request_id", "position"], "left")
    return joined.withColumn("mismatch", ~F.col("given_target").eqNullSafe(F.col("target_id"))).drop("given_target")
