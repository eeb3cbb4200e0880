"""Rules of records and of stored rows: violations are rows, and only require_valid raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.stats import close
from claimlens.operators.scoring import POSITION_LISTS, REDUCED

PREVIEW = 20


def preview(violations: DataFrame) -> list[str]:
    """The first violations by line and rule as text, and how many more there are; none without any."""
    first = violations.orderBy(F.col("line_number").asc_nulls_last(), "rule", "message").limit(PREVIEW).collect()
    shown = [f"- line {r['line_number']} {r['rule']}: {r['message']}" for r in first]
    more = violations.count() - PREVIEW if len(first) == PREVIEW else 0
    return shown + ([f"- ... and {more} more"] if more > 0 else [])


def require_valid(violations: DataFrame) -> None:
    """ValueError with a preview of the violations, if there are any."""
    shown = preview(violations)
    if shown:
        n = int(shown[-1].split()[3]) + PREVIEW if len(shown) > PREVIEW else len(shown)
        raise ValueError(f"validation failed with {n} error(s):\n" + "\n".join(shown))


def span_is_valid(span: Column, text: Column) -> Column:
    inside = (span["start"] >= 0) & (span["start"] < span["end"]) & (span["end"] <= F.length(text))
    return F.coalesce(inside, F.lit(False))


def _rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """line_number, rule, message: one row for each rule that a row of `df` breaks."""
    broken = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(text).alias("message"))) for (rule, text), bad in rules.items()]
    return df.select("line_number", F.explode(F.array_compact(F.array(*broken))).alias("v")).select("line_number", "v.*")


def semantic_violations(records: DataFrame) -> DataFrame:
    """Rules within one record."""
    audit, contrast, claim = F.col("knowledge_audit"), F.col("contrast"), F.col("claim")
    evidence, condition = F.col("evidence_sets"), F.col("evidence_condition")
    known = audit["status"].isin("recall_known", "recognition_known")
    distinct = lambda c: F.size(F.array_distinct(c))
    rules = {
        ("R1", "atomic fact span is invalid"): ~F.forall("atomic_facts", lambda a: span_is_valid(a["claim_span"], claim)),
        ("R2", "condition none with evidence"): (condition == "none") & (F.size(evidence) > 0),
        ("R3", "condition without evidence"): (condition != "none") & (F.size(evidence) == 0),
        ("R4", "evidence_id repeats"): distinct(F.col("evidence_sets.evidence_id")) < F.size(evidence),
        ("R5", "rationale span is invalid"): F.exists(
            evidence, lambda e: F.exists(e["rationale_spans"], lambda s: ~span_is_valid(s, e["text"]))
        ),
        ("R6", "gold evidence without a rationale"): condition.startswith("gold_")
        & F.exists(evidence, lambda e: F.size(e["rationale_spans"]) == 0),
        ("R7", "fewer than two distinct annotators"): distinct(F.col("annotations.annotator_ids")) < 2,
        ("R8", "test example is not verified"): (F.col("split") == "test") & (F.col("annotations.adjudication_status") != "verified"),
        ("R9", "replacement span is invalid"): contrast.isNotNull() & ~span_is_valid(contrast["replacement_span"], claim),
        ("R10", "recognition_passed contradicts status"): audit.isNotNull() & (audit["recognition_passed"] != known),
        ("R11", "passed contradicts status"): audit.isNotNull() & (audit["passed"] != (audit["status"] == "recall_known")),
        ("R12", "top-1 rates differ"): audit.isNotNull()
        & (F.abs(audit["forward_top1_rate"] - audit["recognition_top1_rate"]) > 1e-12),
    }
    return _rows(records, rules)


def cross_row_violations(records: DataFrame) -> DataFrame:
    """Rules between records. Of records that share an id the last is the one that pairs refer to."""
    base = records.select(
        "line_number",
        "example_id",
        "family_id",
        "split",
        "claim",
        F.col("contrast.paired_example_id").alias("paired"),
        F.col("contrast.original_span").alias("original_span"),
        F.col("contrast").isNotNull().alias("has_contrast"),
    )
    by_id = Window.partitionBy("example_id").orderBy("line_number")
    again = base.withColumn("n", F.row_number().over(by_id)).filter("n > 1")
    duplicates = again.select("line_number", F.lit("X1").alias("rule"), F.concat(F.lit("duplicate example_id: "), "example_id").alias("message"))
    splits = base.groupBy("family_id").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
    spans_splits = splits.select(
        F.lit(None).cast("long").alias("line_number"),
        F.lit("X2").alias("rule"),
        F.concat(F.lit("family "), "family_id", F.lit(" spans splits "), F.array_join("splits", ", ")).alias("message"),
    )
    last = base.groupBy(F.col("example_id").alias("paired")).agg(
        F.max_by(F.struct("family_id", "claim", F.col("paired").alias("back")), "line_number").alias("other")
    )
    declared = base.filter("has_contrast")
    joined = declared.join(last, "paired", "left")
    missing, itself = F.col("other").isNull(), F.col("paired") == F.col("example_id")
    pair = ~missing & ~itself
    pair_rules = _rows(
        joined,
        {
            ("X3", "paired example is missing"): missing,
            ("X4", "example is paired with itself"): ~missing & itself,
            ("X5", "pair crosses families"): pair & (F.col("other.family_id") != F.col("family_id")),
            ("X6", "original span is invalid in the paired claim"): pair & ~span_is_valid(F.col("original_span"), F.col("other.claim")),
            ("X7", "pairing is not reciprocal"): pair & ~F.col("other.back").eqNullSafe(F.col("example_id")),
        },
    )
    incoming = declared.groupBy("paired").agg(F.array_sort(F.collect_list("example_id")).alias("from")).filter(F.size("from") > 1)
    crowded = incoming.select(
        F.lit(None).cast("long").alias("line_number"),
        F.lit("X8").alias("rule"),
        F.concat(F.lit("paired example "), "paired", F.lit(" is referenced by "), F.array_join("from", ", ")).alias("message"),
    )
    return duplicates.unionByName(spans_splits).unionByName(pair_rules).unionByName(crowded)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def coherence_rules(kind: str = "cache") -> dict[str, Column]:
    """Rule name -> whether a stored row breaks it. `kind` result adds the logical columns' rules."""
    n, at = F.col("n_masked_pieces"), F.col("masked_positions")
    lists = {c: F.col(c) for c in POSITION_LISTS}
    ids, numbers = POSITION_LISTS[:3], POSITION_LISTS[3:]
    by = {s.removesuffix("_by_piece"): lists[s] for s in numbers}
    good = lambda c, test: F.forall(c, test)

    def pairwise(a: Column, b: Column, test) -> Column:
        return F.forall(F.zip_with(a, b, test), lambda ok: F.coalesce(ok, F.lit(False)))

    lengths = F.lit(True)
    for c in POSITION_LISTS:
        lengths = lengths & (F.size(lists[c]) == n)
    finite, whole = F.lit(True), F.lit(True)
    for c in numbers:
        finite = finite & good(lists[c], _finite)
    for c in ids:
        whole = whole & good(lists[c], lambda x: x >= 0)
    reduced = F.lit(True)
    for name, source in REDUCED.items():
        mean = F.try_divide(F.aggregate(by[source], F.lit(0.0), lambda a, x: a + x), n)
        reduced = reduced & _finite(F.col(name)) & close(F.col(name), mean)
    unit = lambda x: (x >= 0) & (x <= 1)
    ranges = good(by["collision_probability"], lambda x: (x > 0) & (x <= 1)) & good(by["expected_drift"], unit)
    ranges = ranges & good(by["expected_dispersion"], unit) & good(by["top_mismatch"], lambda x: x.isin(0.0, 1.0))
    positive = F.lit(True)
    for s in ("ce", "entropy", "collision_entropy"):
        positive = positive & good(by[s], lambda x: x >= 0)
    tops = F.zip_with("top_ids", "target_ids", lambda a, b: (a != b).cast("double"))
    holds = {
        "C1": F.col("work_id").rlike(r"\A[0-9a-f]{64}\z"),
        "C2": n >= 1,
        "C3": (F.size(at) == n) & good(at, lambda x: x >= 0) & (F.array_sort(F.array_distinct(at)) == at),
        "C4": lengths & finite & whole,
        "C5": positive,
        "C6": ranges,
        "C7": pairwise(lists["top_alternative_ids"], lists["target_ids"], lambda a, b: a != b)
        & pairwise(tops, by["top_mismatch"], lambda a, b: a == b),
        "C8": pairwise(F.zip_with(by["ce"], by["entropy"], lambda a, b: a - b), by["delta"], lambda a, b: close(a, b))
        & pairwise(F.transform(by["collision_probability"], lambda x: -F.ln(x)), by["collision_entropy"], lambda a, b: close(a, b))
        & pairwise(F.transform(by["collision_probability"], lambda x: 1.0 - x), by["expected_dispersion"], lambda a, b: close(a, b))
        & pairwise(F.transform(by["ce"], lambda x: 1.0 - F.exp(-x)), by["expected_drift"], lambda a, b: close(a, b)),
        "C9": reduced,
    }
    if kind == "result":
        named = F.lit(True)
        for c in ("example_id", "family_id", "split", "label", "arm"):
            named = named & (F.col(c) != "")
        pair = F.col("paired_example_id").isNull() | (F.col("paired_example_id") != "")
        rate = F.col("mask_rate")
        holds["C11"] = named & pair & (F.col("mask_index") >= 0) & (rate > 0) & (rate <= 1)
    return {rule: ~F.coalesce(ok, F.lit(False)) for rule, ok in holds.items()}


def coherence_violations(rows: DataFrame, kind: str = "cache") -> DataFrame:
    """work_id, rule of every rule that a stored row breaks."""
    broken = [F.when(bad, F.lit(rule)) for rule, bad in coherence_rules(kind).items()]
    return rows.select("work_id", F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def plan_difference(result_ids: DataFrame, plan_ids: DataFrame, key: str = "work_id") -> DataFrame:
    """key, side: `missing` from the results or `unexpected` in them."""
    have = result_ids.select(key).distinct().withColumn("have", F.lit(True))
    want = plan_ids.select(key).distinct().withColumn("want", F.lit(True))
    joined = have.join(want, key, "full_outer").filter("have is null or want is null")
    return joined.select(key, F.when(F.col("have").isNull(), F.lit("missing")).otherwise("unexpected").alias("side"))


def cache_misses(plan: DataFrame, valid: DataFrame, key: str = "work_id") -> DataFrame:
    """The plan's rows that no valid shard holds."""
    return plan.join(valid.select(key), key, "left_anti")


def overlapping_shards(ids: DataFrame, key: str = "work_id") -> DataFrame:
    """partition_index of shards that hold an id of an earlier one."""
    owner = F.min("partition_index").over(Window.partitionBy(key))
    return ids.withColumn("owner", owner).filter("partition_index > owner").select("partition_index").distinct()
