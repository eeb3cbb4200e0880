"""Reductions, metrics and rules on small tables with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from claimlens.__main__ import aggregation_probe, scored_fixture
from claimlens.operators import evaluation, scoring, validation
from claimlens.sources import artifacts


def test_reductions_agree(spark):
    raw = spark.createDataFrame(
        [("r", 1, 2, [0.1, 0.6, 0.3]), ("r", 0, 0, [0.7, 0.2, 0.1])], "request string, position int, target_id int, probabilities array<double>"
    )
    scored = scoring.score_positions(raw)
    means = scoring.reduce_positions(scored, ["request"]).first()
    lists = scoring.reduce_lists(scoring.statistics_as_lists(scored, ["request"])).first()
    assert lists["masked_positions"] == [0, 1] and lists["target_ids"] == [0, 2] and lists["top_alternative_ids"] == [1, 1]
    for name in ("n_masked_pieces", *scoring.REDUCED):
        assert means[name] == pytest.approx(lists[name])
    assert lists["top_mismatch_rate"] == 0.5


def plain_auroc(rows):
    pos = [v for v, label in rows if label == "refuted"]
    neg = [v for v, label in rows if label == "supported"]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))


@pytest.mark.parametrize("partitions", [1, 3])
def test_auroc_against_all_pairs(spark, partitions):
    rng = random.Random(4)
    rows = [(a, "s", i, rng.choice(evaluation.LABELS), round(rng.random(), d)) for a, d in (("x", 1), ("y", 6)) for i in range(400)]
    rows += [("z", "s", 1, "supported", 0.5)]
    df = spark.createDataFrame(rows, "arm string, score string, example_id int, label string, value double").repartition(partitions)
    got = {r["arm"]: r["auroc"] for r in evaluation.claim_auroc(df).collect()}
    for arm in "xyz":
        want = plain_auroc([(r[4], r[3]) for r in rows if r[0] == arm])
        assert got[arm] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_order_and_partitions_keep_every_bit(spark):
    """Means that would differ in the last bit by the order of summation, and ties that hang on it."""
    rng = random.Random(8)
    rows = []
    for e in range(120):
        pair, label = f"e{e ^ 1}", "refuted" if e % 2 else "supported"
        values = rng.choice([[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2], [1e-7, 0.1, 0.7], [rng.random() for _ in range(7)]])
        rows += [(f"e{e}", f"f{e // 12}", "dev", label, pair, "prior", i, v) for i, v in enumerate(values)]
    kind = "example_id string, family_id string, split string, label string, paired_example_id string, arm string, mask_index int, s double"
    told = []
    for turn in range(6):
        rng.shuffle(rows)
        masks = spark.createDataFrame(rows, kind).repartition(1 + turn)
        masks = masks.select("*", *[F.col("s").alias(c) for c in evaluation.SUMMARY]).drop("s")
        told.append(evaluation.evaluation_document(masks))
    assert all(t == told[0] for t in told)
    score = told[0]["arms"]["prior"]["scores"]["ce_mean"]
    claims = {r["example_id"]: r["ce_mean"] for r in evaluation.reduce_claims(masks).collect()}
    gaps = [claims[f"e{e + 1}"] - claims[f"e{e}"] for e in range(0, 120, 2)]
    assert score["declared_contrasts"]["wins"] == sum(g > 0 for g in gaps) and 0.0 in gaps
    assert {x for x in claims.values() if abs(x - 0.2) < 1e-12} == {0.2}


def test_probe_pair_and_family_disagree(spark):
    claims = evaluation.reduce_claims(aggregation_probe(spark))
    assert claims.filter("example_id = 'pair-supported'").first()["ce_mean"] == 2.0
    row = evaluation.arm_metrics(claims).filter("score = 'ce_mean'").first()
    assert (row["n_declared_contrasts"], row["contrast_wins"], row["contrast_mean_gap"]) == (1, 0, -1.5)
    assert (row["n_binary_families"], row["family_wins"], row["family_mean_gap"]) == (1, 1, 4.25)
    assert row["auroc"] == 0.75


def test_no_pairs_give_null_rates(spark):
    lone = aggregation_probe(spark).filter("example_id = 'extra-refuted'")
    row = evaluation.arm_metrics(evaluation.reduce_claims(lone)).first()
    assert (row["n_declared_contrasts"], row["contrast_win_rate"], row["auroc"]) == (0, None, None)


def test_document_refuses_bad_rows(spark):
    probe = aggregation_probe(spark)
    with pytest.raises(ValueError, match="empty"):
        evaluation.evaluation_document(probe.limit(0))
    with pytest.raises(ValueError, match="duplicate mask_index"):
        evaluation.evaluation_document(probe.union(probe))
    with pytest.raises(ValueError, match="paired reduction is missing"):
        evaluation.evaluation_document(probe.filter("example_id <> 'pair-refuted'"))
    with pytest.raises(ValueError, match="inconsistent label"):
        evaluation.evaluation_document(probe.withColumn("label", F.when(F.col("mask_index") == 1, "refuted").otherwise(F.col("label"))))
    with pytest.raises(ValueError, match="non-finite"):
        evaluation.evaluation_document(probe.withColumn("ce_mean", F.lit(float("nan"))))


def test_document_counts(spark):
    document = evaluation.evaluation_document(aggregation_probe(spark))
    arm = document["arms"]["prior"]
    assert document["n_mask_rows"] == 6 and document["n_claim_rows"] == 4 and not document["interpretation_allowed"]
    assert arm["label_counts"] == {"supported": 2, "refuted": 2, "insufficient": 0, "ambiguous": 0} and arm["n_families"] == 1


DAMAGE = {
    "C1": {"work_id": lambda: F.upper("work_id")},
    "C2": {"n_masked_pieces": lambda: F.lit(0)},
    "C3": {"masked_positions": lambda: F.transform("masked_positions", lambda x: x - 1)},
    "C4": {"ce_by_piece": lambda: F.transform("ce_by_piece", lambda x: F.lit(float("nan")))},
    "C5": {"entropy_by_piece": lambda: F.transform("entropy_by_piece", lambda x: -x)},
    "C6": {"top_mismatch_by_piece": lambda: F.transform("top_mismatch_by_piece", lambda x: x + 0.5)},
    "C7": {"top_alternative_ids": lambda: F.col("target_ids")},
    "C8": {"expected_drift_by_piece": lambda: F.transform("expected_drift_by_piece", lambda x: x * 0.5)},
    "C9": {"swap_llr_mean": lambda: F.col("swap_llr_mean") + 1e-6},
    "C11": {"mask_rate": lambda: F.lit(0.0)},
}


@pytest.mark.parametrize("rule", DAMAGE)
def test_coherence(spark, rule):
    rows = scored_fixture(spark)
    assert validation.coherence_violations(rows, "result").isEmpty()
    found = validation.coherence_violations(rows.withColumns({c: made() for c, made in DAMAGE[rule].items()}), "result")
    assert rule in {r["rule"] for r in found.select("rule").distinct().collect()}


def test_plan_difference_and_misses(spark):
    have, want = (spark.createDataFrame([(x,) for x in ids], "work_id string") for ids in ("ab", "bc"))
    assert {tuple(r) for r in validation.plan_difference(have, want).collect()} == {("a", "unexpected"), ("c", "missing")}
    assert [r[0] for r in validation.cache_misses(want, have).collect()] == ["c"]


def test_cache_rows_have_no_metadata(spark):
    assert artifacts.cache_rows(scored_fixture(spark)).columns == artifacts.CACHE_SCHEMA.names
    assert "label" not in artifacts.CACHE_SCHEMA.names


def test_marginals_attach_by_key(spark):
    requests = spark.createDataFrame([("r", [1, 0]), ("s", [1])], "request_id string, target_ids array<int>")
    rows = [("s", 0, 0, [0.5, 0.5]), ("r", 1, 0, [0.25, 0.75]), ("r", 0, 1, [0.5, 0.5]), ("t", 0, 0, [1.0, 0.0])]
    marginals = spark.createDataFrame(rows, "request_id string, position int, target_id int, probabilities array<double>")
    got = {(r["request_id"], r["position"]): (r["target_id"], r["probabilities"], r["mismatch"]) for r in scoring.attach_marginals(requests, marginals).collect()}
    assert got == {("r", 0): (1, [0.5, 0.5], False), ("r", 1): (0, [0.25, 0.75], False), ("s", 0): (1, [0.5, 0.5], True)}


def test_results_carry_their_metadata(spark):
    raw = spark.createDataFrame([("w", 0, 0, [0.5, 0.5])], "work_id string, position int, target_id int, probabilities array<double>")
    lists = scoring.statistics_as_lists(scoring.score_positions(raw), ["work_id"])
    meta = spark.createDataFrame([("w", "a"), ("v", "b")], "work_id string, example_id string")
    row = scoring.result_rows(lists, meta).first()
    assert (row["example_id"], row["n_masked_pieces"], row["top_mismatch_rate"]) == ("a", 1, 0.0)


def test_overlapping_shards(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 2)], "work_id string, partition_index int")
    assert [r[0] for r in validation.overlapping_shards(ids).collect()] == [2]
