"""Scoring over streams: the batch operators are row-wise up to the reductions, so they apply as they are.

Publication stays single-writer: every micro-batch becomes one cache partition named by its batch id,
so that a replayed batch finds its own content sealed and changes nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from claimlens.operators.scoring import reduce_lists, score_positions, statistics_as_lists
from claimlens.sources.artifacts import CACHE_SCHEMA, local_environment, publish_shard


def score_stream(positions: DataFrame) -> DataFrame:
    """Statistics of every position of a stream, without state."""
    return score_positions(positions)


def publish_stream(
    positions: DataFrame, cache: str | Path, *, plan_hash: str, fingerprint: dict, plan: DataFrame, checkpoint: str
) -> StreamingQuery:
    """Start a query that publishes (work_id, position, target_id, probabilities) as cache shards.

    All positions of a work_id have to arrive in one micro-batch.
    """

    def seal(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = reduce_lists(statistics_as_lists(score_positions(batch), ["work_id"])).select(*CACHE_SCHEMA.names)
        publish_shard(
            cache,
            rows,
            partition_index=batch_id,
            plan_hash=plan_hash,
            fingerprint=fingerprint,
            plan=plan,
            environment=local_environment(batch.sparkSession),
        )

    return positions.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
