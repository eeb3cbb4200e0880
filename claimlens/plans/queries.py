"""Registered queries and their SQL.

The tables map onto the data model so that every operator has real input: a claim is an order, its arm
l_returnflag, a mask l_linenumber (repeats reduced by min), its family o_custkey, its label the order's
status and its pair the key with the last bit flipped. Doubles are rounded to 6 decimals on both
sides (9 where six are a tie); gaps and scores are rounded to 9 before they are compared, since sums differ in the last bits.

Rules and errors are shown on rows of the tables that are damaged by their number, one damage for each.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import fixtures
from claimlens.functions import identity, text
from claimlens.functions.stats import STATISTICS, close, softmax, valid_probabilities
from claimlens.operators import evaluation, scoring, validation
from claimlens.sources import artifacts, records
from claimlens.sources.records import evidence_for_arm
from claimlens.sources.scratch import scratch_path, written

MASK_ID = 99
SEED = 7
N_MASKS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, decimals: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding 0 makes -0.0 and 0.0 one."""
    return df.withColumns({c: F.round(c, decimals) + 0.0 for c in columns})


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"), F.pmod("label", F.size("embedding")).alias("target_id")
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_logits(_logits(spark, sf_dir))


def softmax_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _logits(spark, sf_dir).select("vec_id", F.posexplode(softmax(F.col("logits"))).alias("token_id", "probability"))
    return rounded(p, "probability", decimals=9)


def marginal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir), *STATISTICS)


def reduce_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("request_id", F.floor(F.col("vec_id") / 5))
    return rounded(scoring.reduce_positions(scored, ["request_id"]), *scoring.REDUCED)


def statistics_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("request_id", F.floor(F.col("vec_id") / 5)).withColumn("position", F.col("vec_id") % 5)
    listed = scoring.reduce_lists(scoring.statistics_as_lists(scored, ["request_id"]))
    told = [F.array_join(c, ",").alias(c) for c in ("masked_positions", "target_ids", "top_ids", "top_alternative_ids")]
    return rounded(listed.select("request_id", *told, "n_masked_pieces", "ce_mean", "swap_llr_mean"), "ce_mean", "swap_llr_mean")


def _measures() -> dict[str, Column]:
    quantity, price = F.min("l_quantity"), F.min("l_extendedprice")
    return {
        "ce_mean": price / 10000,
        "entropy_mean": quantity / 10,
        "collision_entropy_mean": quantity / 20,
        "delta_mean": price / 10000 - quantity / 10,
        "swap_llr_mean": F.min("l_tax") * 10 - F.min("l_discount") * 10,
        "expected_drift_mean": quantity / 50,
        "expected_dispersion_mean": F.min("l_discount") * 10,
        "top_mismatch_rate": (quantity > 25).cast("double"),
    }


def _label(status: Column) -> Column:
    return F.when(status == "F", F.lit("refuted")).when(status == "O", F.lit("supported")).otherwise("insufficient")


def _mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(
        *[m.alias(name) for name, m in _measures().items()]
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return masks.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("example_id"),
        F.col("l_returnflag").alias("arm"),
        F.col("l_linenumber").alias("mask_index"),
        F.col("o_custkey").alias("family_id"),
        F.lit("dev").alias("split"),
        _label(F.col("o_orderstatus")).alias("label"),
        F.col("o_orderkey").bitwiseXOR(F.lit(1)).alias("paired_example_id"),
        *_measures(),
    )


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose pair id is NULL where the partner has no claim in the arm. Masks are reduced once."""
    claims = written(evaluation.reduce_claims(_mask_rows(spark, sf_dir)), "claims")
    there = claims.select(F.col("example_id").alias("paired_example_id"), "arm", F.lit(True).alias("there"))
    joined = claims.join(there, ["paired_example_id", "arm"], "left")
    return joined.withColumn("paired_example_id", F.when(F.col("there"), F.col("paired_example_id"))).drop("there")


def reduce_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = evaluation.reduce_claims(_mask_rows(spark, sf_dir))
    return rounded(claims.drop("split", "paired_example_id"), *evaluation.SUMMARY, decimals=9)


def claim_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_orderkey").alias("example_id"),
        F.col("l_returnflag").alias("arm"),
        F.col("l_linenumber").alias("mask_index"),
        F.col("l_suppkey").alias("family_id"),
        F.col("l_linestatus").alias("split"),
        F.lit("supported").alias("label"),
        F.lit(None).cast("string").alias("paired_example_id"),
        *[F.col("l_tax").alias(c) for c in evaluation.SUMMARY],
    )
    return evaluation.claim_guards(rows)


def claim_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = evaluation.reduce_claims(_mask_rows(spark, sf_dir))
    scores = written(rounded(evaluation.long_scores(claims), "value", decimals=9).select("arm", "score", "label", "value"), "scores")
    return rounded(evaluation.claim_auroc(scores), "auroc")


def declared_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.declared_contrasts(_claims(spark, sf_dir), 9), "win_rate", "mean_gap")


def family_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.family_gaps(evaluation.reduce_claims(_mask_rows(spark, sf_dir)), 9), "win_rate", "mean_gap")


def arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = written(evaluation.reduce_claims(_mask_rows(spark, sf_dir)), "claims")
    metrics = evaluation.arm_metrics(claims, 9)
    return rounded(metrics, "auroc", "contrast_win_rate", "contrast_mean_gap", "family_win_rate", "family_mean_gap")


def evaluation_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's scores as rows, from mask rows whose pairs are all there. Masks have 6 decimals, and their means
    are compared as they are."""
    masks = rounded(_mask_rows(spark, sf_dir), *evaluation.SUMMARY)
    pairs = _claims(spark, sf_dir).select("example_id", "arm", "paired_example_id")
    whole = masks.drop("paired_example_id").join(pairs, ["example_id", "arm"])
    document = evaluation.evaluation_document(whole)
    rows = [
        (arm, score, x["claim_auroc"], x["declared_contrasts"]["n_declared_contrasts"], x["declared_contrasts"]["mean_gap"],
         x["families"]["n_binary_families"], x["families"]["mean_gap"], found["n_claims"], found["n_families"], document["n_mask_rows"])
        for arm, found in document["arms"].items() for score, x in found["scores"].items()
    ]
    names = "arm string, score string, auroc double, n_declared_contrasts long, contrast_mean_gap double, n_binary_families long, family_mean_gap double, n_claims long, n_families long, n_mask_rows long"
    return rounded(spark.createDataFrame(rows, names), "auroc", "contrast_mean_gap", "family_mean_gap")


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = _mask_rows(spark, sf_dir)
    return evaluation.run_counts(masks.withColumn("work_id", F.sha2(F.concat_ws("-", "example_id", "mask_index").cast("binary"), 256)))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.label_counts(_claims(spark, sf_dir))


def missing_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.missing_partners(evaluation.reduce_claims(_mask_rows(spark, sf_dir)))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").withColumn("spans", text.word_spans(F.col("text")))
    return items.withColumn("words", F.col("spans.text"))


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _benchmark(spark, sf_dir).select("item_id", F.posexplode("spans").alias("word_index", "s"))
    return spans.select("item_id", "word_index", F.col("s.text").alias("word"), F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({text.WORD})"), F.lit(1))
    words = table(spark, sf_dir, "documents").select("doc_id", found.alias("words"))
    count = lambda test: F.size(F.filter("words", test)).cast("long")
    return words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        count(text.is_maskable).alias("n_maskable"),
        count(text.is_content).alias("n_content"),
    )


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = F.explode(F.sequence(F.lit(0), F.lit(N_MASKS - 1)))
    items = _benchmark(spark, sf_dir).withColumn("eligible", text.eligible_words(F.col("words"))).withColumn("mask_index", masks)
    digest = text.mask_digest(F.lit(SEED), F.col("item_id"), F.lit("prior"), F.col("mask_index"))
    masked = items.withColumn("digest", digest).withColumn("mask_rate", text.mask_rate(F.col("digest")))
    return masked.withColumn("chosen", text.masked_words(F.col("eligible"), F.col("digest")))


def mask_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir).select("item_id", "mask_index", "mask_rate", F.array_join("chosen", ",").alias("word_indices"))


def _offsets(n: Column) -> Column:
    """Fixed pieces of four characters over a text of n."""
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda k: F.array(4 * k, F.least(4 * k + 4, n)))


def word_piece_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _benchmark(spark, sf_dir).withColumn("pieces", text.word_pieces(F.col("spans"), _offsets(F.length("text"))))
    aligned = items.select("item_id", F.posexplode("pieces").alias("word_index", "own"))
    return aligned.select("item_id", "word_index", F.array_join("own", ",").alias("pieces"))


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are pieces of their own here, numbered from 100; masks choose among them."""
    pieces = F.transform("words", lambda w, i: F.array(i))
    tokens = F.transform("words", lambda w, i: F.length(w) + 100)
    masked = _masks(spark, sf_dir).withColumn("token_ids", tokens)
    return masked.withColumn("g", text.mask_geometry(F.col("token_ids"), pieces, F.col("chosen"), MASK_ID))


def mask_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = [F.array_join(f"g.{c}", ",").alias(c) for c in ("piece_indices", "target_ids", "masked_input_ids")]
    return _geometry(spark, sf_dir).select("item_id", "mask_index", *told)


def _work_fields() -> dict[str, Column]:
    named = {f: F.lit(f"{f}-v1") for f in identity.STRING_FIELDS}
    return named | {
        "scoring_protocol": F.lit(identity.ANALYTIC),
        "arm": F.lit("prior"),
        "mask_policy": F.lit(text.POLICY),
        "input_ids": F.col("g.masked_input_ids"),
        "attention_mask": F.transform("token_ids", lambda t: F.lit(1)),
        "masked_positions": F.col("g.piece_indices"),
        "target_ids": F.col("g.target_ids"),
        "mask_rate": F.col("mask_rate"),
        "temperature": F.lit(1.0),
    }


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(spark, sf_dir).select("item_id", "mask_index", identity.work_id(_work_fields()).alias("work_id"))


def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _works(spark, sf_dir)


def id_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = _works(spark, sf_dir).withColumn("partition_index", F.col("item_id") % 5)
    plan = shards.groupBy("partition_index").agg(identity.ids_digest(F.collect_list("work_id"), False).alias("plan_hash"))
    stats = identity.shard_statistics(shards, ["partition_index"]).drop("has_duplicates")
    return stats.join(plan, "partition_index")


def plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("work_id"))
    plan = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("work_id"))
    return validation.plan_difference(results, plan)


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"))
    valid = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("work_id"))
    return validation.cache_misses(plan, valid)


def overlapping_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), (F.col("l_suppkey") % 50).alias("partition_index"))
    return validation.overlapping_shards(ids)


def _order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: some ids repeat, some pairs are missing, crossed or one-sided."""
    key = F.col("o_orderkey")
    claim = F.concat(F.lit("Order "), key.cast("string"))
    pair = (F.when(key % 5 == 0, key).when(key % 7 == 0, key + 2_000_000).when(key % 11 == 0, key + 2).otherwise(key.bitwiseXOR(F.lit(1)))).cast("string")
    span = F.struct(F.lit(0).alias("start"), (F.lit(7) + key % 6).cast("int").alias("end"))
    contrast = F.when(key % 3 != 0, F.struct(pair.alias("paired_example_id"), span.alias("original_span"), span.alias("replacement_span")))
    orders = table(spark, sf_dir, "orders").select(
        key.alias("line_number"),
        key.cast("string").alias("example_id"),
        (F.col("o_custkey") % 100).cast("string").alias("family_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("test")).otherwise("dev").alias("split"),
        claim.alias("claim"),
        contrast.alias("contrast"),
    )
    # a later record of the same id stands for it where pairs refer to it
    again = orders.filter("line_number % 97 = 0").withColumns({"line_number": F.col("line_number") + 10_000_000, "family_id": F.lit("0")})
    return orders.union(again)


def cross_row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.cross_row_violations(_order_records(spark, sf_dir))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.sum("line_number").alias("lines"))


def semantic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("line_number")
    evidence = F.struct(
        (key % 2).cast("string").alias("evidence_id"),
        F.lit("twelve chars").alias("text"),
        F.when(key % 4 == 0, F.array().cast("array<struct<start:int,end:int>>"))
        .otherwise(F.array(F.struct(F.lit(1).alias("start"), (key % 15).cast("int").alias("end"))))
        .alias("rationale_spans"),
    )
    sets = F.when(key % 6 == 0, F.array().cast("array<struct<evidence_id:string,text:string,rationale_spans:array<struct<start:int,end:int>>>>"))
    rate = (key % 10) / 10
    status = F.when(key % 3 == 0, F.lit("recall_known")).when(key % 3 == 1, F.lit("recognition_known")).otherwise("weak")
    audit = F.struct(
        status.alias("status"),
        (key % 4 < 2).alias("recognition_passed"),
        (key % 5 == 0).alias("passed"),
        rate.alias("recognition_top1_rate"),
        F.when(key % 13 == 0, rate + 0.01).otherwise(rate).alias("forward_top1_rate"),
    )
    records = _order_records(spark, sf_dir).withColumns(
        {
            "atomic_facts": F.array(F.struct(F.struct(F.lit(0).alias("start"), (key % 12).cast("int").alias("end")).alias("claim_span"))),
            "evidence_condition": F.when(key % 5 < 2, F.lit("none")).when(key % 5 == 2, F.lit("gold_supporting")).otherwise("retrieved"),
            "evidence_sets": sets.when(key % 9 == 0, F.array(evidence, evidence)).otherwise(F.array(evidence)),
            "annotations": F.struct(
                F.array(F.lit("a"), (key % 4).cast("string"), F.lit("a")).alias("annotator_ids"),
                F.when(key % 2 == 0, F.lit("verified")).otherwise("pending").alias("adjudication_status"),
            ),
            "knowledge_audit": F.when(key % 8 != 0, audit),
        }
    )
    one = records.withColumn("annotations", F.when(key % 17 == 0, F.col("annotations").withField("annotator_ids", F.array(F.lit("a")))).otherwise(F.col("annotations")))
    found = validation.semantic_violations(one)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.sum("line_number").alias("lines"))


def _stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the scored embeddings: five make a request."""
    scored = _scored(spark, sf_dir).withColumn("request", F.floor(F.col("vec_id") / 5)).withColumn("position", F.col("vec_id") % 5)
    lists = scoring.statistics_as_lists(scored, ["request"]).withColumn("work_id", F.sha2(F.col("request").cast("string").cast("binary"), 256))
    name = F.concat(F.lit("request-"), F.col("request").cast("string"))
    return scoring.reduce_lists(lists).withColumns(
        {
            "example_id": name,
            "family_id": F.lit("embeddings"),
            "split": F.lit("dev"),
            "label": F.lit("supported"),
            "paired_example_id": F.lit(None).cast("string"),
            "arm": F.lit("prior"),
            "mask_index": F.lit(0),
            "mask_rate": F.lit(0.5),
        }
    )


def physical_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows, about half of them damaged in one of eleven ways."""
    damages = [
        ("work_id", F.upper("work_id")),
        ("masked_positions", F.reverse("masked_positions")),
        ("ce_mean", F.col("ce_mean") * 1.01),
        ("delta_by_piece", F.transform("delta_by_piece", lambda x: x + 1)),
        ("top_alternative_ids", F.col("target_ids")),
        ("n_masked_pieces", F.lit(0)),
        ("swap_llr_by_piece", F.transform("swap_llr_by_piece", lambda x: F.lit(float("nan")))),
        ("collision_entropy_by_piece", F.transform("collision_entropy_by_piece", lambda x: -x)),
        ("expected_drift_by_piece", F.transform("expected_drift_by_piece", lambda x: x + 1)),
        ("mask_rate", F.lit(0.0)),
        ("paired_example_id", F.lit("")),
    ]
    rows = _stored_rows(spark, sf_dir)
    damaged = reduce(lambda df, d: df.withColumn(d[1][0], F.when(F.col("request") % 25 == d[0], d[1][1]).otherwise(F.col(d[1][0]))), enumerate(damages, 1), rows)
    return validation.coherence_violations(damaged, "result").groupBy("rule").agg(F.count("*").alias("n"))


def evidence_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    arms = turns.withColumn("arm", F.explode(F.array(F.lit("prior"), F.lit("supplied_evidence"))))
    return arms.select("conv_id", "arm", F.sha2(evidence_for_arm(F.col("t.text"), F.col("arm")).cast("binary"), 256).alias("evidence_sha256"))


#: A record with places for an order's key, and what is replaced in it by damage 1, 2, ...
_RECORD = {
    "schema_version": "2.0", "example_id": "e@", "family_id": "f@", "split": "dev", "claim": "Order @ is late.", "label": "refuted",
    "domain": "trade", "fact_type": "date", "prior_familiarity": "unknown",
    "knowledge_audit": {
        "checkpoint": "c", "status": "weak", "audit_version": "1", "recognition_top1_rate": 0.5, "cloze_recall_exact_rate": 0,
        "forward_top1_rate": 0.5, "median_correct_probability": 0.25, "median_logprob_margin": -3, "recognition_passed": False,
        "passed": False, "audited_at": "2024-02-29T10:00:00Z",
    },
    "claim_origin": {"kind": "human", "author": "us"}, "evidence_condition": "retrieved",
    "evidence_sets": [
        {"evidence_id": "v", "stance": "neutral", "text": "Evidence @.", "retrieval_rank": 1, "rationale_spans": [],
         "source": {"title": "t", "url_or_corpus_id": "u", "publisher": "p", "published_at": None, "accessed_at": "a", "license": "l"}},
    ],
    "atomic_facts": [{"atomic_id": "a", "text": "x", "label": "refuted", "claim_span": {"start": 0, "end": 5}}],
    "contrast": {"paired_example_id": "p@", "edit_role": "date", "original_span": {"start": 0, "end": 5}, "replacement_span": {"start": 0, "end": 5}},
    "annotations": {"annotator_ids": ["x", "y"], "agreement": 0.5, "adjudication_status": "pending", "notes": ""},
    "provenance": {"dataset": "orders", "source_example_id": None, "created_at": "2024", "license": "none"},
}
_DAMAGES = (
    ('"domain": "trade", ', ""),
    ('"domain": "trade"', '"domain": "trade", "extra": 1'),
    ('"2.0"', '"1.0"'),
    ('"created_at": "2024"', '"created_at": ""'),
    ('"prior_familiarity": "unknown"', '"prior_familiarity": "some"'),
    ('"2024-02-29T10:00:00Z"', '"2024-13-45T99:99:99Z"'),
    ('"kind": "human"', '"kind": "robot"'),
    ('"retrieved"', '"found"'),
    ('"retrieval_rank": 1', '"retrieval_rank": 0'),
    ('"claim_span": {"start": 0, "end": 5}', '"claim_span": {"start": 0.5, "end": 5}'),
    ('"edit_role": "date"', '"edit_role": "compositional"'),
    ('"agreement": 0.5', '"agreement": 1.5'),
    ('"notes": ""', '"notes": "\\ud800"'),
    ('"notes": ""', '"notes": ' + "[" * 20_000),
    ('"retrieval_rank": 1', '"retrieval_rank": ' + "9" * 5_000),
    ('"median_logprob_margin": -3', '"median_logprob_margin": true'),
)


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines, each of the first keys modulo 23 with one damage."""
    key = F.col("o_orderkey")
    line = F.replace(F.lit(json.dumps(_RECORD)), F.lit("@"), key.cast("string"))
    cases = reduce(lambda c, d: c.when(key % 23 == d[0], F.replace(line, F.lit(d[1][0]), F.lit(d[1][1]))), enumerate(_DAMAGES, 1), F)
    return table(spark, sf_dir, "orders").select(key.alias("line_number"), cases.otherwise(line).alias("raw"))


def record_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structural violation with its lines, and the lines without any, read back as typed records; the
    format is loaded from a JSON Schema."""
    folder = _local_folder(spark, "schema")
    folder.mkdir(parents=True)
    (folder / "records.json").write_text(json.dumps(records.schema_of(records.RECORD)))
    kind = records.load_schema(str(folder / "records.json"))
    checked = written(records.checked_lines(_record_lines(spark, sf_dir), kind), "checked")
    broken = checked.select("line_number", F.explode("errors").alias("violation"))
    typed = records.typed_records(checked).filter(F.col("example_id") == F.concat(F.lit("e"), F.col("line_number").cast("string")))
    told = broken.union(typed.select("line_number", F.lit("none").alias("violation")))
    return told.groupBy("violation").agg(F.count("*").alias("n"), F.sum("line_number").alias("lines"))


def scoring_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = records.typed_records(records.checked_lines(_record_lines(spark, sf_dir)))
    return records.scoring_view(typed).withColumn("evidence_texts", F.array_join("evidence_texts", "|"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations as one text file, with blank lines between, numbered as they are read."""
    path = scratch_path(spark, "lines")
    names = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    names.select(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, "\n \t").otherwise("")).alias("value")).write.text(path)
    return records.read_lines(spark, path)


def violation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a refusal shows: the first violations in order, and how many more there are."""
    shown = validation.preview(validation.cross_row_violations(_order_records(spark, sf_dir)).filter("line_number is not null"))
    return spark.createDataFrame(list(enumerate(shown)), "place long, shown string")


def invalid_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions damaged by their number; only those that are valid, with a target among them, are scored."""
    p, by = softmax(F.col("logits")), F.col("vec_id") % 10
    first = lambda value: F.transform("p", lambda x, i: F.when(i == 0, F.lit(value)).otherwise(x))
    damaged = (
        F.when(by == 1, first(-1e-3))
        .when(by == 2, F.transform("p", lambda x: x * (1 + 1e-6)))
        .when(by == 3, first(float("nan")))
        .when(by == 4, first(float("inf")))
        .when(by == 5, F.array(F.lit(1.0)))
        .when(by == 6, F.transform("p", lambda x: x * (1 + 5e-9)))
        .when(by == 7, F.lit(None))
        .otherwise(F.col("p"))
    )
    target = F.when(by == 8, F.size("p")).when(by == 9, F.lit(-1)).otherwise(F.col("target_id"))
    rows = _logits(spark, sf_dir).withColumn("p", p).select("vec_id", damaged.alias("probabilities"), target.alias("target_id"))
    scored = scoring.score_positions(rows.withColumn("valid", valid_probabilities(F.col("probabilities"))))
    return scored.select("vec_id", "valid", F.col("ce").isNotNull().alias("scored"))


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of canonical JSON of nested rows, with nulls, quotes, control characters and numbers."""
    part = table(spark, sf_dir, "part")
    by = F.col("p_partkey") % 4
    odd = F.when(by == 1, F.lit('q"uote\\')).when(by == 2, F.lit("tab\tbell\x07 é")).when(by == 3, F.lit(None)).otherwise(F.col("p_name"))
    inner = F.struct(odd.alias("z"), (by == 0).alias("a"), F.array(F.col("p_partkey"), by).alias("m"))
    row = F.struct(inner.alias("nested"), F.col("p_retailprice").cast("double").alias("Price"), (by / 4).alias("share"))
    rows = part.select("p_partkey", row.alias("row"))
    return rows.select("p_partkey", F.sha2(identity.json_value(F.col("row"), rows.schema["row"].dataType).cast("binary"), 256).alias("row_sha256"))


def work_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons for which fields have no identity; undamaged ones have none."""
    by = F.col("vec_id") % 13
    ids = lambda *values: F.array(*map(F.lit, values)).cast("array<int>")
    fields = {f: F.lit(f) for f in identity.STRING_FIELDS} | {
        "arm": F.when(by == 1, F.lit("")).otherwise("prior"),
        "scoring_protocol": F.when(by == 9, F.lit("other")).otherwise(identity.ANALYTIC),
        "input_ids": F.when(by == 2, ids(1)).when(by == 3, ids()).otherwise(ids(1, 2, 3)),
        "attention_mask": F.when(by == 4, ids(1, 2, 0)).when(by == 3, ids()).otherwise(ids(1, 1, 0)),
        "masked_positions": F.when(by == 5, ids(0, 0)).when(by == 6, ids(0, 3)).when(by.isin(2, 3), ids(0)).otherwise(ids(0, 1)),
        "target_ids": F.when(by == 7, ids(1)).when(by.isin(2, 3), ids(1)).otherwise(ids(1, 2)),
        "mask_rate": F.when(by == 8, F.lit(0.0)).when(by == 12, F.lit(float("nan"))).otherwise(0.5),
        "temperature": F.when(by.isin(9, 10), F.lit(2.0)).when(by == 11, F.lit(-1.0)).otherwise(1.0),
    }
    reasons = F.array_join(identity.work_errors(fields), "; ")
    return table(spark, sf_dir, "embeddings").select(reasons.alias("reasons"), "vec_id").groupBy("reasons").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def alignment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a piece of their own each, and the same with a piece missing, malformed, or over two words."""
    by, spans = F.col("item_id") % 5, F.col("spans")
    own = F.transform(spans, lambda s: F.array(s["start"], s["end"]))
    worded = F.filter(spans, lambda s: text.is_maskable(s["text"]))
    offsets = (
        F.when(by == 1, F.filter(own, lambda o: F.get(o, F.lit(0)) != F.get(worded, F.lit(0))["start"]))
        .when(by == 2, F.array_append(own, F.array(F.lit(0), F.length("text") + 1)))
        .when(by == 3, F.array_append(own, F.array(F.lit(0), F.length("text"))))
        .when(by == 4, F.array_append(own, F.array(F.lit(2), F.lit(2))))
        .otherwise(own)
    )
    pieces = text.word_pieces(spans, F.col("offsets"))
    found = _benchmark(spark, sf_dir).withColumn("offsets", offsets)
    return found.select("item_id", F.array_join(text.alignment_errors(F.col("text"), spans, F.col("offsets"), pieces), "; ").alias("errors"))


def geometry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of words that aren't there, have no piece, or share one."""
    by = F.col("item_id") % 6
    nested = lambda *rows: F.array(*[F.array(*map(F.lit, r)).cast("array<int>") for r in rows])
    pieces = F.when(by == 1, nested((0,), (), (2,))).when(by == 2, nested((0,), (0, 1), (2,))).when(by == 3, nested((0,), (7,), (2,))).otherwise(nested((0,), (1,), (2,)))
    chosen = F.when(by == 4, F.array(F.lit(0), F.lit(3))).when(by == 5, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(1)))
    told = text.mask_geometry(F.array(F.lit(5), F.lit(6), F.lit(7)), pieces, chosen, MASK_ID)
    return table(spark, sf_dir, "benchmark").select("item_id", told.alias("g")).select("item_id", F.coalesce("g.error", F.lit("none")).alias("error"))


def attach_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of orders, some without their example and some with another text than its claim."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    requests = orders.select(key.alias("request_id"), key.alias("example_id"), F.when(key % 5 == 0, F.lit("another")).otherwise(F.concat(F.lit("Order "), key.cast("string"))).alias("text"))
    examples = orders.filter(key % 7 != 0).select(
        key.alias("example_id"), F.col("o_custkey").cast("string").alias("family_id"), F.lit("dev").alias("split"), _label(F.col("o_orderstatus")).alias("label"),
        F.lit(None).cast("long").alias("paired_example_id"), F.concat(F.lit("Order "), key.cast("string")).alias("claim"),
    )
    return records.attach_examples(requests, examples).select("request_id", "family_id", "label", "mismatch")


def attach_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of requests with their marginals, in a file that lacks some and has others of another target."""
    vectors = _logits(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 5).cast("string").alias("request_id"), (F.col("vec_id") % 5).cast("int").alias("position"), F.col("target_id").cast("int").alias("target_id"), "vec_id", softmax(F.col("logits")).alias("probabilities")
    )
    targets = F.transform(F.array_sort(F.collect_list(F.struct("position", "target_id"))), lambda s: s["target_id"])
    requests = vectors.groupBy("request_id").agg(targets.alias("target_ids"))
    given = vectors.filter("vec_id % 7 <> 0").withColumn("target_id", F.when(F.col("vec_id") % 11 == 0, F.col("target_id") + 1).otherwise(F.col("target_id")))
    path = scratch_path(spark, "marginals")
    given.drop("vec_id").write.parquet(path)
    found = scoring.attach_marginals(requests, records.read_marginals(spark, path))
    return found.select("request_id", "position", "target_id", F.col("probabilities").isNotNull().alias("found"), "mismatch")


def plan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of the benchmark as the one document of a fixed-mask plan, read back."""
    request = F.struct(F.concat_ws("-", "item_id", "mask_index").alias("request_id"), "item_id", "mask_index", F.array_join("chosen", ",").alias("word_indices"))
    plan = _masks(spark, sf_dir).agg(F.collect_list(request).alias("requests")).select(F.lit("synthetic-correctness-smoke").alias("fixture_kind"), F.lit(MASK_ID).alias("mask_token_id"), "requests")
    path = scratch_path(spark, "plan")
    plan.coalesce(1).write.json(path)
    found = records.read_mask_plan(spark, path)
    return found.select("request_id", F.col("item_id").cast("long").alias("item_id"), F.col("mask_index").cast("int").alias("mask_index"), "word_indices", F.col("mask_token_id").cast("int").alias("mask_token_id"))


def _local_folder(spark: SparkSession, name: str) -> Path:
    return Path(urlparse(scratch_path(spark, name)).path)


def _refused(do: Callable) -> bool:
    try:
        do()
    except ValueError:
        return True
    return False


def cache_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards are published, one again, one damaged, inspected, repaired, hydrated and read.

    One row for each step and partition: the generation, how the partition was found, and its rows.
    """
    folder = _local_folder(spark, "cache")
    rows = written(_stored_rows(spark, sf_dir).withColumn("p", F.col("request") % 3), "stored")
    plan = rows.select("work_id")
    told = {"plan_hash": "a" * 64, "fingerprint": fixtures.FINGERPRINT, "plan": plan}
    parts = [artifacts.cache_rows(rows.filter(F.col("p") == p).select(*artifacts.RESULT_SCHEMA.names)) for p in range(3)]
    environment = artifacts.local_environment(spark)
    publish = lambda p, q, **more: artifacts.publish_shard(folder, parts[q], partition_index=p, environment=environment, **told, **more)
    out = []

    def note(step: str, generation: int, states: dict[int, tuple[str, int]]) -> None:
        out.extend((step, p, generation, state, n) for p, (state, n) in states.items())

    def entries(manifest: dict) -> dict[int, tuple[str, int]]:
        return {e["partition_index"]: ("sealed", e["row_count"]) for e in manifest["shards"]}

    for p in range(3):
        manifest = publish(p, p)
    note("published", manifest["generation"], entries(manifest))
    again = publish(1, 1)
    note("repeated", again["generation"], entries(again))
    note("replaced", manifest["generation"], {1: ("refused" if _refused(lambda: publish(1, 2)) else "changed", 0)})
    (folder / manifest["shards"][2]["name"]).write_bytes(b"damaged")
    found = artifacts.inspect_cache(spark, folder / artifacts.MANIFEST, **told)
    states = {s.partition_index: ("valid", s.row_count) for s in found.valid} | {f.partition_index: ("failed", 0) for f in found.failures}
    note("damaged", manifest["generation"], states)
    note("unrepaired", manifest["generation"], {p: ("refused" if _refused(lambda p=p: publish(p, p)) else "changed", 0) for p in (0, 2)})
    repaired = publish(2, 2, repair=True)
    note("repaired", repaired["generation"], entries(repaired))
    valid = artifacts.validate_cache(spark, folder / artifacts.MANIFEST, **told)
    copies = artifacts.hydrate(valid, folder / "local")
    read = artifacts.read_shards(spark, copies).join(rows.select("work_id", "p"), "work_id").groupBy("p").agg(F.count("*").alias("n")).collect()
    note("hydrated", repaired["generation"], {r["p"]: ("read", r["n"]) for r in read})
    return spark.createDataFrame(out, "step string, partition_index int, generation int, state string, n_rows long")


def sealed_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the scored embeddings, sealed with its receipt and read back from it."""
    rows = _stored_rows(spark, sf_dir).select(*artifacts.RESULT_SCHEMA.names)
    results, receipt = artifacts.write_bundle(_local_folder(spark, "run"), rows, receipt={"run_uuid": "sealed"}, plan=rows.select("work_id"))
    told = json.loads(receipt.read_text())
    ids = pq.read_table(results, columns=["work_id"])["work_id"].to_pylist()
    whole = told["status"] == "complete" and told["results"]["sha256"] == artifacts.sha256_file(results) and ids == sorted(ids)
    read = artifacts.read_results(spark, results).select("work_id", "example_id", "n_masked_pieces", "ce_mean", "entropy_mean", F.array_join("target_ids", ",").alias("target_ids"))
    return rounded(read.withColumns({"n_rows": F.lit(told["results"]["row_count"]).cast("long"), "whole": F.lit(whole)}), "ce_mean", "entropy_mean")


def protocol_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the artifact protocol takes and refuses, case by case."""
    rows = written(_stored_rows(spark, sf_dir).select(*artifacts.RESULT_SCHEMA.names), "stored")
    folder = _local_folder(spark, "protocol")
    cache, plan = artifacts.cache_rows(rows), rows.select("work_id")
    given = {"plan_hash": "b" * 64, "fingerprint": fixtures.FINGERPRINT}
    environment = artifacts.local_environment(spark)
    manifest = artifacts.publish_shard(folder / "c", cache, partition_index=0, plan=plan, environment=environment, **given)
    entry = manifest["shards"][0]

    def manifested(change: dict, in_entry: dict | None = None) -> Callable:
        def run():
            shards = [entry | in_entry] if in_entry is not None else [entry]
            artifacts.write_json(folder / "m" / artifacts.MANIFEST, manifest | {"shards": shards} | change)
            artifacts.read_manifest(folder / "m" / artifacts.MANIFEST, **given)

        return run

    prints = lambda **change: lambda: artifacts.require_fingerprint(fixtures.FINGERPRINT | change)
    bundle = lambda n, data, receipt: lambda: artifacts.write_bundle(folder / n, data, receipt=receipt, plan=plan)
    cases = {
        "C10 cache columns": lambda: artifacts.checked_rows(cache, "cache"),
        "C10 a column more": lambda: artifacts.checked_rows(cache.withColumn("label", F.lit("x")), "cache"),
        "C10 a column less": lambda: artifacts.checked_rows(cache.drop("ce_mean"), "cache"),
        "C10 no rows": lambda: artifacts.checked_rows(cache.limit(0), "cache"),
        "C11 result columns": lambda: artifacts.checked_rows(rows, "result"),
        "C11 a column less": lambda: artifacts.checked_rows(rows.drop("label"), "result"),
        "C12 fingerprint": prints(),
        "C12 empty field": prints(dtype=""),
        "C12 a field more": prints(more="x"),
        "C12 temperature 2": prints(temperature=2.0),
        "C12 temperature 2, other protocol": prints(temperature=2.0, scoring_protocol="other"),
        "C12 temperature 0": prints(temperature=0, scoring_protocol="other"),
        "C13 environment": lambda: artifacts.require_environment(environment),
        "C13 a field less": lambda: artifacts.require_environment({"python": "3"}),
        "C14 manifest": manifested({}),
        "C14 generation 0": manifested({"generation": 0}),
        "C14 generation true": manifested({"generation": True}),
        "C14 a key more": manifested({"more": 1}),
        "C14 no shards": manifested({"shards": []}),
        "C14 other plan": manifested({"plan_hash": "c" * 64}),
        "C14 whole temperature": manifested({"fingerprint": fixtures.FINGERPRINT | {"temperature": 1}}),
        "C15 name": manifested({}, {"name": "../x.parquet"}),
        "C15 row count": manifested({}, {"row_count": 0}),
        "C15 range": manifested({}, {"first_work_id": "f" * 64}),
        "C15 digest": manifested({}, {"work_ids_sha256": "x"}),
        "C15 repeated partition": manifested({"shards": [entry, entry]}),
        "K2 not a number": lambda: artifacts.write_json(folder / "x.json", {"x": float("nan")}),
        "K4 run": bundle("run", rows, {"run_uuid": "u"}),
        "K4 occupied folder": bundle("run", rows, {"run_uuid": "u"}),
        "K4 no run_uuid": bundle("r1", rows, {"run_uuid": " "}),
        "K4 gate without a reason": bundle("r2", rows, {"run_uuid": "u", "interpretation_allowed": True}),
        "K4 repeated rows": bundle("r3", rows.union(rows), {"run_uuid": "u"}),
        "K4 rows less than planned": bundle("r4", rows.limit(1), {"run_uuid": "u"}),
        "S6 other format": lambda: artifacts.read_results(spark, next((folder / "c").glob("part-*"))),
        "S8 unplanned ids": lambda: artifacts.validate_cache(spark, folder / "c" / artifacts.MANIFEST, plan=plan.limit(1), **given),
        "K6 cache": lambda: artifacts.validate_cache(spark, folder / "c" / artifacts.MANIFEST, plan=plan, **given),
    }
    return spark.createDataFrame([(name, not _refused(do)) for name, do in cases.items()], "case string, accepted boolean")


def offline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the offline check passes, from the packaged fixtures to the repaired cache."""
    from claimlens.__main__ import offline_check as checked

    return spark.createDataFrame(list(enumerate(checked(spark))), "place long, passed string")


def tolerance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") * (1 + (F.col("p_partkey") % 7) * 3e-11)).alias("b"))
    return part.groupBy(close(F.col("a"), F.col("b")).alias("agrees")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        softmax_probabilities, marginal_stats, reduce_positions, statistics_lists, reduce_claims, claim_guards,
        claim_auroc, declared_contrasts, family_gaps, arm_metrics, evaluation_document, run_counts, label_counts,
        missing_partners, word_spans, content_words, mask_plan, word_piece_alignment, alignment_errors, mask_geometry,
        geometry_errors, work_ids, work_errors, id_digests, plan_diff, cache_misses, overlapping_shards,
        cross_row_violations, violation_preview, semantic_violations, physical_coherence, evidence_by_arm,
        record_structure, scoring_view, numbered_lines, plan_requests, attach_examples, attach_marginals,
        invalid_distributions, canonical_rows, cache_lifecycle, sealed_bundle, protocol_checks, offline_check, tolerance_checks,
    )
}
