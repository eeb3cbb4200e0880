"""python -m claimlens check: the offline check, from records and a mask plan to sealed results and cache repair."""

from __future__ import annotations

import argparse
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import fixtures
from claimlens.functions import identity, text
from claimlens.functions.stats import close
from claimlens.operators import evaluation, scoring
from claimlens.sources import artifacts, records


def _expect(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"offline check failed: {what}")


def scored_fixture(spark: SparkSession, parts: int = 2, reverse: bool = False) -> DataFrame:
    """Result rows of the fixture's requests; neither order nor partitions may change them."""
    rows = fixtures.MARGINALS[::-1] if reverse else fixtures.MARGINALS
    raw = spark.createDataFrame(rows, "request string, position int, target_id int, probabilities array<double>")
    scored = scoring.score_positions(raw.repartition(parts))
    lists = scoring.statistics_as_lists(scored, ["request"])
    family, label = F.substring_index("request", "-", 1), F.substring_index("request", "-", -1)
    fields = {f: F.lit(fixtures.FINGERPRINT.get(f, "prior")) for f in identity.STRING_FIELDS} | {
        "input_ids": F.transform("target_ids", lambda t: F.lit(99)),
        "attention_mask": F.transform("target_ids", lambda t: F.lit(1)),
        "masked_positions": F.col("masked_positions"),
        "target_ids": F.col("target_ids"),
        "mask_rate": F.lit(0.5),
        "temperature": F.lit(1.0),
    }
    rows = scoring.reduce_lists(lists).select(
        identity.work_id(fields).alias("work_id"),
        F.col("request").alias("example_id"),
        family.alias("family_id"),
        F.lit("dev").alias("split"),
        label.alias("label"),
        F.concat(family, F.when(label == "refuted", F.lit("-supported")).otherwise("-refuted")).alias("paired_example_id"),
        F.lit("prior").alias("arm"),
        F.lit(0).alias("mask_index"),
        F.lit(0.5).alias("mask_rate"),
        "masked_positions",
        "n_masked_pieces",
        *scoring.POSITION_LISTS,
        *scoring.REDUCED,
    )
    return rows


def aggregation_probe(spark: SparkSession) -> DataFrame:
    rows = [(e, "probe", "dev", label, pair, "prior", i, s) for e, label, pair, scores in fixtures.AGGREGATION for i, s in enumerate(scores)]
    base = spark.createDataFrame(
        rows, "example_id string, family_id string, split string, label string, paired_example_id string, arm string, mask_index int, s double"
    )
    return base.select("*", *[F.col("s").alias(c) for c in evaluation.SUMMARY]).drop("s")


def planned_requests(requests: DataFrame, examples: DataFrame) -> DataFrame:
    """Requests of a plan with what follows from their text: `errors` tells where the plan says otherwise."""
    spans = text.word_spans(F.col("text"))
    digest = text.mask_digest(F.lit(fixtures.SEED), F.col("example_id"), F.col("arm"), F.col("mask_index"))
    made = (
        records.attach_examples(requests, examples)
        .withColumn("spans", spans)
        .withColumn("pieces", text.word_pieces(F.col("spans"), F.col("offsets")))
        .withColumn("aligned", text.alignment_errors(F.col("text"), F.col("spans"), F.col("offsets"), F.col("pieces")))
        .withColumn("drawn", text.masked_words(text.eligible_words(F.col("spans.text")), digest))
        .withColumn("geometry", text.mask_geometry(F.col("token_ids"), F.col("pieces"), F.col("drawn"), fixtures.MASK_ID))
    )
    fields = {f: F.lit(fixtures.FINGERPRINT.get(f, "prior")) for f in identity.STRING_FIELDS} | {
        "input_ids": F.col("geometry.masked_input_ids"),
        "attention_mask": F.transform("token_ids", lambda t: F.lit(1)),
        "masked_positions": F.col("geometry.piece_indices"),
        "target_ids": F.col("geometry.target_ids"),
        "mask_rate": text.mask_rate(digest),
        "temperature": F.lit(1.0),
    }
    says = lambda column, value: ~F.col(column).cast("string").eqNullSafe(value.cast("string"))
    wrong = {
        "example": F.col("mismatch"),
        "alignment": F.size("aligned") > 0,
        "mask rate": F.col("mask_rate") != fields["mask_rate"],
        "words": says("word_indices", F.col("drawn")),
        "geometry": F.col("geometry.error").isNotNull() | says("masked_input_ids", fields["input_ids"]) | says("target_ids", fields["target_ids"]),
        "identity": (F.size(identity.work_errors(fields)) > 0) | (F.col("work_id") != identity.work_id(fields)),
    }
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in wrong.items()]))
    return made.withColumn("errors", errors)


def planned_results(requests: DataFrame, marginals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored positions with `agrees`, result rows) of requests and their saved marginals."""
    positions = scoring.attach_marginals(requests.select("request_id", "work_id", "target_ids"), marginals)
    scored = scoring.score_positions(positions)
    agrees = ~F.col("mismatch")
    for name in fixtures.EXPECTED:
        agrees = agrees & F.coalesce(close(F.col(name), F.col(f"expected_{name}"), 1e-12, 1e-12), F.lit(False))
    scored = scored.join(marginals.drop("probabilities", "target_id"), ["request_id", "position"]).withColumn("agrees", agrees)
    lists = scoring.statistics_as_lists(scored, ["work_id"]).drop("masked_positions")
    logical = ["example_id", "family_id", "split", "label", "paired_example_id", "arm", "mask_index", "mask_rate"]
    metadata = requests.select("work_id", *logical, F.col("piece_indices").alias("masked_positions"))
    return scored, scoring.result_rows(lists, metadata)


def offline_check(spark: SparkSession, folder: str | Path | None = None) -> list[str]:
    """The lines of what passes; ValueError for the first thing that doesn't. `folder` has fixtures of
    another making than the packaged ones."""
    with tempfile.TemporaryDirectory() as made:
        if folder is None:
            fixtures.write(made)
        return _checked(spark, Path(folder or made), Path(made, "out"))


def _checked(spark: SparkSession, given: Path, out: Path) -> list[str]:
    passed = []
    probe = evaluation.evaluation_document(aggregation_probe(spark))["arms"]["prior"]["scores"]["ce_mean"]
    _expect(probe["declared_contrasts"] == {"n_declared_contrasts": 1, "wins": 0, "win_rate": 0.0, "mean_gap": -1.5}, "pair metrics")
    _expect(probe["families"] == {"n_binary_families": 1, "wins": 1, "win_rate": 1.0, "mean_gap": 4.25}, "family metrics")
    _expect(probe["claim_auroc"] == 0.75, "AUROC")
    passed.append("aggregation: masks, pairs and families are reduced apart")

    typed, examples = records.load_records(spark, fixtures.fixture_path(fixtures.RECORDS, given))
    n_records, n_families = typed.agg(F.count("*"), F.count_distinct("family_id")).first()
    _expect(n_records == 2 * n_families, "a family has a supported and a refuted record")
    passed.append(f"records: {n_records} records of {n_families} families are valid")

    plan_rows = records.read_mask_plan(spark, fixtures.fixture_path(fixtures.PLAN, given))
    requests = planned_requests(plan_rows, examples)
    wrong = requests.filter(F.size("errors") > 0).select("request_id", "errors").limit(20).collect()
    _expect(not wrong, "; ".join(f"{r['request_id']}: {', '.join(r['errors'])}" for r in wrong))
    again = planned_requests(plan_rows.orderBy(F.desc("request_id")).repartition(5), examples)
    _expect(requests.select("request_id", "work_id").exceptAll(again.select("request_id", "work_id")).isEmpty(), "order changes work ids")
    passed.append("plan: alignment, masks, geometry and work ids follow from the claims, in any order")

    requests = requests.withColumn("piece_indices", F.col("geometry.piece_indices"))
    scored, results = planned_results(requests, records.read_marginals(spark, fixtures.fixture_path(fixtures.SAVED, given)))
    _expect(scored.filter(~F.col("agrees")).isEmpty() and not scored.isEmpty(), "saved statistics")
    results = results.select(*artifacts.RESULT_SCHEMA.names).persist()
    document = evaluation.evaluation_document(results)
    ce = document["arms"]["prior"]["scores"]["ce_mean"]
    _expect(ce["claim_auroc"] == 1.0 and ce["families"]["wins"] == n_families, "separation of the fixture")
    passed.append("scoring: saved statistics agree, and refuted claims score above supported ones")

    plan, counts = results.select("work_id"), evaluation.run_counts(results).first().asDict()
    _, receipt = artifacts.write_bundle(out / "run", results, receipt={"run_uuid": "offline", "metrics": document}, plan=plan)
    _expect(artifacts.read_results(spark, receipt.with_name("results.parquet")).count() == counts["n_work_ids"] == n_records, "sealed rows")
    passed.append(f"bundle: {counts['n_mask_rows']} results and their receipt are sealed")

    cache = out / "cache"
    digest = identity.plan_digest(plan)
    told = {"plan_hash": digest, "fingerprint": fixtures.FINGERPRINT, "plan": plan}
    environment = artifacts.local_environment(spark)
    rows = artifacts.cache_rows(results)
    publish = lambda **more: artifacts.publish_shard(cache, rows, partition_index=0, environment=environment, **told, **more)
    _expect(publish()["generation"] == 1 and publish()["generation"] == 1, "publication repeats")
    shard = cache / artifacts.read_manifest(cache / artifacts.MANIFEST, digest, fixtures.FINGERPRINT)["shards"][0]["name"]
    shard.write_bytes(b"damaged")
    _expect(artifacts.inspect_cache(spark, cache / artifacts.MANIFEST, **told).failed(0), "damage goes unseen")
    _expect(publish(repair=True)["generation"] == 2, "repair")
    valid = artifacts.validate_cache(spark, cache / artifacts.MANIFEST, **told)
    _expect(len(artifacts.hydrate(valid, out / "local")) == 1, "hydration")
    results.unpersist()
    passed.append("cache: a damaged shard is isolated and repaired")
    return passed


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimlens")
    check = parser.add_subparsers(dest="command", required=True).add_parser("check", help="run the offline check")
    check.add_argument("--fixtures", help="folder with records, plan and marginals instead of the packaged ones")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    try:
        for line in offline_check(spark, given.fixtures):
            print(f"PASS {line}")
    except (OSError, ValueError) as reason:
        print(f"claimlens: {reason}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
