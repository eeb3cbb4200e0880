"""The record scan: structure, rules within a record, rules between records."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators.validation import cross_row_violations, semantic_violations
from claimlens.sources import records


def claim(example, pair, label, text="Lake Vell holds 12 islands.", other=None):
    return {
        "schema_version": "2.0",
        "example_id": example,
        "family_id": "vell",
        "split": "dev",
        "claim": text,
        "label": label,
        "domain": "made up",
        "fact_type": "number",
        "prior_familiarity": "unavailable",
        "knowledge_audit": None,
        "claim_origin": {"kind": "human", "author": "us"},
        "evidence_condition": "none",
        "evidence_sets": [],
        "atomic_facts": [{"atomic_id": "a", "text": text, "label": label, "claim_span": {"start": 0, "end": len(text)}}],
        "contrast": {
            "paired_example_id": pair,
            "edit_role": "number",
            "original_span": {"start": 16, "end": 18},
            "replacement_span": {"start": 16, "end": 18},
        },
        "annotations": {"annotator_ids": ["x", "y"], "agreement": 1.0, "adjudication_status": "verified", "notes": ""},
        "provenance": {"dataset": "own", "source_example_id": None, "created_at": "2024", "license": "none"},
    }


EVIDENCE = {
    "evidence_id": "e",
    "stance": "supports",
    "text": "Twelve.",
    "source": {"title": "t", "url_or_corpus_id": "u", "publisher": "p", "published_at": None, "accessed_at": "a", "license": "l"},
    "rationale_spans": [{"start": 0, "end": 6}],
}
AUDIT = {
    "checkpoint": "c",
    "status": "recall_known",
    "audit_version": "1",
    "recognition_top1_rate": 0.5,
    "cloze_recall_exact_rate": 1,
    "forward_top1_rate": 0.5,
    "median_correct_probability": 0.25,
    "median_logprob_margin": -3,
    "recognition_passed": True,
    "passed": True,
}


@pytest.fixture
def pair():
    return [claim("a", "b", "supported"), claim("b", "a", "refuted")]


def write(tmp_path, rows):
    path = tmp_path / "claims.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_load(spark, tmp_path, pair):
    pair[0] |= {"evidence_condition": "gold_supporting", "evidence_sets": [EVIDENCE], "knowledge_audit": AUDIT}
    del pair[1]["contrast"]
    pair[0]["contrast"] = None
    typed, view = records.load_records(spark, write(tmp_path, [pair[0], "", "  ", pair[1]]))
    assert [r["line_number"] for r in typed.sort("line_number").collect()] == [1, 4]
    row = view.filter("example_id = 'a'").first()
    assert len(view.columns) == 13
    assert (row["evidence_texts"], row["knowledge_status"], row["knowledge_passed"]) == (["Twelve."], "recall_known", True)
    other = view.filter("example_id = 'b'").first()
    assert (other["paired_example_id"], other["knowledge_status"], other["evidence_texts"]) == (None, None, [])


def edited(row, path, value):
    row = copy.deepcopy(row)
    *most, last = path
    at = row
    for key in most:
        at = at[key]
    if value is None and last == "claim":
        del at[last]
    else:
        at[last] = value
    return row


@pytest.mark.parametrize(
    ("path", "value", "reason"),
    [
        (("claim",), None, "<row>: missing key claim"),
        (("extra",), 1, "<row>: unknown key extra"),
        (("annotations", "extra"), 1, "annotations: unknown key extra"),
        (("schema_version",), "1.0", "schema_version: not an allowed value"),
        (("example_id",), "", "example_id: too short"),
        (("example_id",), True, "example_id: not a string"),
        (("contrast", "edit_role"), "compositional", "contrast.edit_role: not an allowed value"),
        (("atomic_facts",), [], "atomic_facts: too few items"),
        (("atomic_facts", 0, "claim_span", "start"), -1, "atomic_facts.0.claim_span.start: out of range"),
        (("atomic_facts", 0, "claim_span", "start"), True, "atomic_facts.0.claim_span.start: not an integer"),
        (("annotations", "agreement"), 1.5, "annotations.agreement: out of range"),
        (("annotations", "annotator_ids"), ["x"], "annotations.annotator_ids: too few items"),
        (("knowledge_audit",), AUDIT | {"audited_at": "yesterday"}, "knowledge_audit.audited_at: not a date-time"),
        (("knowledge_audit",), AUDIT | {"audited_at": "2024-13-45T99:99:99Z"}, "knowledge_audit.audited_at: not a date-time"),
        (("knowledge_audit",), AUDIT | {"audited_at": "2023-02-29T10:00:00Z"}, "knowledge_audit.audited_at: not a date-time"),
        (("knowledge_audit",), AUDIT | {"audited_at": "2024-02-28T10:00:00+24:00"}, "knowledge_audit.audited_at: not a date-time"),
        (("knowledge_audit",), AUDIT | {"passed": 1}, "knowledge_audit.passed: not a boolean"),
        (("evidence_sets",), [EVIDENCE | {"retrieval_rank": 0}], "evidence_sets.0.retrieval_rank: out of range"),
    ],
)
def test_structure(pair, path, value, reason):
    found = [f"{p}: {r}" for p, r in records.structure_errors(records.RECORD, edited(pair[0], path, value))]
    assert reason in found


@pytest.mark.parametrize(
    ("rule", "changes"),
    [
        ("R1", {("atomic_facts", 0, "claim_span", "end"): 99}),
        ("R1", {("atomic_facts", 0, "claim_span", "end"): 3.0}),
        ("R2", {("evidence_sets",): [EVIDENCE]}),
        ("R3", {("evidence_condition",): "retrieved"}),
        ("R4", {("evidence_condition",): "retrieved", ("evidence_sets",): [EVIDENCE, EVIDENCE]}),
        ("R5", {("evidence_condition",): "retrieved", ("evidence_sets",): [EVIDENCE | {"rationale_spans": [{"start": 0, "end": 8}]}]}),
        ("R6", {("evidence_condition",): "gold_refuting", ("evidence_sets",): [EVIDENCE | {"rationale_spans": []}]}),
        ("R7", {("annotations", "annotator_ids"): ["x", "x"]}),
        ("R8", {("split",): "test", ("annotations", "adjudication_status"): "pending"}),
        ("R9", {("contrast", "replacement_span", "end"): 99}),
        ("R10", {("knowledge_audit",): AUDIT | {"recognition_passed": False}}),
        ("R11", {("knowledge_audit",): AUDIT | {"passed": False}}),
        ("R12", {("knowledge_audit",): AUDIT | {"forward_top1_rate": 0.6}}),
    ],
)
def test_semantic_rules(spark, tmp_path, pair, rule, changes):
    row = pair[0]
    for path, value in changes.items():
        row = edited(row, path, value)
    typed = records.typed_records(records.checked_lines(records.read_lines(spark, write(tmp_path, [row]))))
    assert {r["rule"] for r in semantic_violations(typed).collect()} == {rule}


@pytest.mark.parametrize(
    ("rules", "change"),
    [
        ({"X1", "X8"}, lambda p: p.append(copy.deepcopy(p[0]))),
        ({"X2"}, lambda p: p[0].update(split="calibration")),
        ({"X3", "X7"}, lambda p: p[0]["contrast"].update(paired_example_id="gone")),
        ({"X4", "X7"}, lambda p: p[0]["contrast"].update(paired_example_id="a")),
        ({"X5"}, lambda p: p[0].update(family_id="other")),
        ({"X6"}, lambda p: p[0]["contrast"].update(original_span={"start": 0, "end": 99})),
        ({"X7"}, lambda p: p[0].update(contrast=None)),
        ({"X7", "X8"}, lambda p: p.append(claim("c", "b", "refuted"))),
    ],
)
def test_cross_row_rules(spark, tmp_path, pair, rules, change):
    change(pair)
    path = write(tmp_path, pair)
    typed = records.typed_records(records.checked_lines(records.read_lines(spark, path)))
    assert {r["rule"] for r in cross_row_violations(typed).collect()} - {"X8" if "X8" not in rules else ""} >= rules - {"X8"}
    assert rules <= {r["rule"] for r in cross_row_violations(typed).collect()}
    with pytest.raises(ValueError, match="validation failed"):
        records.load_records(spark, path)


def test_original_span_is_of_the_paired_claim(spark, tmp_path):
    long = claim("a", "b", "supported", "Lake Vell holds 1200 islands.")
    short = claim("b", "a", "refuted", "Lake Vell holds 9.")
    long["contrast"]["original_span"] = {"start": 16, "end": 17}
    short["contrast"] |= {"original_span": {"start": 16, "end": 20}, "replacement_span": {"start": 16, "end": 17}}
    assert records.load_records(spark, write(tmp_path, [long, short]))[0].count() == 2


def test_errors_are_previewed(spark, tmp_path, pair):
    with pytest.raises(ValueError, match=r"25 error\(s\)(?s:.*)and 5 more"):
        records.load_records(spark, write(tmp_path, ["{nonsense"] * 25 + pair))
    with pytest.raises(ValueError, match="no records"):
        records.load_records(spark, write(tmp_path, [""]))


def test_no_line_ends_a_scan(spark, tmp_path, pair):
    """Lines that JSON parsers choke on are violations; the others are read."""
    half = json.dumps(pair[0]).replace('"dataset":', '"dataset": "\\ud800", "dataset_":')
    whole = edited(pair[0], ("claim",), pair[0]["claim"] + " \U0001f30a")
    rows = ['{"a": "\\ud800"}', "[" * 200_000, "9" * 5_000, '{"\\udfff": 1}', half.replace('"dataset_": "', '"x": "'), whole, pair[1], "\ufffd"]
    lines = records.read_lines(spark, write(tmp_path, rows))
    checked = {r["line_number"]: r["errors"] for r in records.checked_lines(lines).collect()}
    assert sorted(checked) == list(range(1, 9)) and not checked[6] and not checked[7]
    assert checked[2] == ["invalid JSON: nested too deeply"] and checked[3] == ["invalid JSON: integer of too many digits"]
    assert "<row>: unknown key ?" in checked[4] and checked[8][0].startswith("invalid JSON")
    one = edited(pair[0], ("claim",), "half \ud800 of a pair")
    assert records.checked_line(json.dumps(one))[1] == ["invalid JSON: half of a surrogate pair"]
    typed = records.typed_records(records.checked_lines(lines))
    assert typed.filter("line_number = 6").first()["claim"].endswith("\U0001f30a")


def test_line_numbers_over_splits(spark, tmp_path):
    """Numbers are those of the file, however it is cut into splits and wherever lines end."""
    rng = random.Random(3)
    ends = ["\n", "\r\n", "\n\n", "\n \t\n"]
    content, want, number = "", {}, 1
    for i in range(4000):
        line, end = f"{i} " + "x" * rng.randint(0, 60), rng.choice(ends)
        content += line + end
        want[number] = line
        number += end.count("\n")
    (tmp_path / "a.txt").write_bytes(content.encode())
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.txt").write_text("")
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (limit, "7001"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = records.read_lines(spark, str(tmp_path / "a.txt"))
            assert {r["line_number"]: r["raw"] for r in lines.collect()} == want
        assert lines.rdd.getNumPartitions() > 4
        assert records.read_lines(spark, str(tmp_path / "b")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.load_records(spark, str(tmp_path / "none.jsonl"))


def test_schema_round_trip(spark, tmp_path, pair):
    (tmp_path / "s.json").write_text(json.dumps(records.schema_of(records.RECORD) | {"$id": "any", "title": "records"}))
    assert records.load_schema(str(tmp_path / "s.json")) == records.load_schema() == records.RECORD
    narrow = records.schema_of(records.RECORD)
    narrow["properties"]["domain"] = {"$ref": "#/$defs/domain"}
    (tmp_path / "n.json").write_text(json.dumps(narrow | {"$defs": {"domain": {"const": "lakes"}}}))
    with pytest.raises(ValueError, match="domain: not an allowed value"):
        records.load_records(spark, write(tmp_path, pair), str(tmp_path / "n.json"))
    with pytest.raises(ValueError, match="no readable schema"):
        records.load_schema(str(tmp_path / "none.json"))


@pytest.mark.parametrize(
    "schema",
    [
        {"type": "string"},
        {"type": "object"},
        {"type": "object", "additionalProperties": False, "required": ["a"]},
        {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "strange"}}},
        {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "string", "pattern": "x"}}},
        {"type": "object", "additionalProperties": False, "properties": {"a": {"$ref": "#/$defs/none"}}},
        {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "string", "format": "email"}}},
        {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "array"}}},
        [],
    ],
)
def test_schemas_that_are_refused(tmp_path, schema):
    (tmp_path / "s.json").write_text(json.dumps(schema))
    with pytest.raises(ValueError):
        records.load_schema(str(tmp_path / "s.json"))


def test_evidence_for_arm(spark):
    df = spark.createDataFrame([(["a", "b"], "prior"), (["a", "b"], "supplied_evidence")], "t array<string>, arm string")
    assert [r[0] for r in df.select(records.evidence_for_arm(F.col("t"), F.col("arm"))).collect()] == ["", "a\n\nb"]
    for row in (([], "supplied_evidence"), (["a"], "other")):
        bad = spark.createDataFrame([row], "t array<string>, arm string")
        with pytest.raises(Exception, match="evidence"):
            bad.select(records.evidence_for_arm(F.col("t"), F.col("arm"))).collect()


def test_plan_and_marginals(spark, tmp_path):
    plan = {"fixture_kind": "synthetic-correctness-smoke", "mask_token_id": 9, "requests": [{"request_id": "r", "example_id": "a", "text": "t"}]}
    (tmp_path / "plan.json").write_text(json.dumps(plan, indent=1))
    requests = records.read_mask_plan(spark, str(tmp_path / "plan.json"))
    assert requests.first()["mask_token_id"] == 9
    examples = spark.createDataFrame([("a", "f", "dev", "supported", None, "t")], "example_id string, family_id string, split string, label string, paired_example_id string, claim string")
    assert not records.attach_examples(requests, examples).first()["mismatch"]
    assert records.attach_examples(requests, examples.limit(0)).first()["mismatch"]
    (tmp_path / "plan.json").write_text(json.dumps(plan | {"fixture_kind": "x"}))
    with pytest.raises(ValueError, match="kind"):
        records.read_mask_plan(spark, str(tmp_path / "plan.json"))
