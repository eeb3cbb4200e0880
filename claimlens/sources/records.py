"""JSONL scan of claim records: structure as violations, valid rows as a typed DataFrame.

A line that can't be read is a violation like any other and never ends a scan.

JSON Schema types can't be told from a typed parse (a number reads as a string, 1.0 as NULL), so the
structural rules run over Arrow batches of raw lines; everything after is Column expressions.
"""

from __future__ import annotations

import calendar
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT, ANY_TEXT = ("text", 1), ("text", 0)
NUMBER, RATE = ("number", None, None), ("number", 0, 1)
FLAG = ("flag",)


def _one_of(*values: str):
    return ("one of", values)


def _maybe(kind):
    return ("or null", kind)


def _list(kind, least: int = 0):
    return ("list", kind, least)


def _object(required: dict, optional: dict | None = None):
    return ("object", required, optional or {})


#: The record format 2.0, with no other keys at any level.
LABELS = ("supported", "refuted", "insufficient", "ambiguous")
SPLITS = ("dev", "calibration", "test", "transfer")
EDIT_ROLES = ("entity", "relation", "number", "date", "negation_or_sign", "qualifier", "comparison", "causal", "other")
FACT_TYPES = (*EDIT_ROLES[:-1], "compositional", "other")
CONDITIONS = (
    "none", "gold_supporting", "gold_refuting", "insufficient", "irrelevant_similar", "conflicting", "retrieved", "poisoned",
)
STATUSES = ("recall_known", "recognition_known", "weak", "unknown")
SPAN = _object({"start": ("whole", 0), "end": ("whole", 0)})
RECORD = _object(
    {
        "schema_version": _one_of("2.0"),
        "example_id": TEXT,
        "family_id": TEXT,
        "split": _one_of(*SPLITS),
        "claim": TEXT,
        "label": _one_of(*LABELS),
        "domain": TEXT,
        "fact_type": _one_of(*FACT_TYPES),
        "prior_familiarity": _one_of("common", "long_tail", "unavailable", "unknown"),
        "knowledge_audit": _maybe(
            _object(
                {
                    "checkpoint": TEXT,
                    "status": _one_of(*STATUSES),
                    "audit_version": TEXT,
                    "recognition_top1_rate": RATE,
                    "cloze_recall_exact_rate": RATE,
                    "forward_top1_rate": RATE,
                    "median_correct_probability": RATE,
                    "median_logprob_margin": NUMBER,
                    "recognition_passed": FLAG,
                    "passed": FLAG,
                },
                {"model_revision": ANY_TEXT, "candidate_sha256": ANY_TEXT, "audited_at": ("moment",)},
            )
        ),
        "claim_origin": _object(
            {"kind": _one_of("human", "minimal_edit", "paraphrase", "model_generated", "external_dataset"), "author": TEXT},
            {"generator_model": _maybe(ANY_TEXT), "generator_prompt_id": _maybe(ANY_TEXT)},
        ),
        "evidence_condition": _one_of(*CONDITIONS),
        "evidence_sets": _list(
            _object(
                {
                    "evidence_id": TEXT,
                    "stance": _one_of("supports", "refutes", "neutral", "conflicts"),
                    "text": TEXT,
                    "source": _object(
                        {
                            "title": TEXT,
                            "url_or_corpus_id": TEXT,
                            "publisher": TEXT,
                            "published_at": _maybe(ANY_TEXT),
                            "accessed_at": TEXT,
                            "license": TEXT,
                        }
                    ),
                    "rationale_spans": _list(SPAN),
                },
                {"retrieval_rank": _maybe(("whole", 1)), "retrieval_score": _maybe(NUMBER)},
            )
        ),
        "atomic_facts": _list(_object({"atomic_id": TEXT, "text": TEXT, "label": _one_of(*LABELS), "claim_span": SPAN}), 1),
        "annotations": _object(
            {
                "annotator_ids": _list(TEXT, 2),
                "agreement": RATE,
                "adjudication_status": _one_of("pending", "verified", "rejected"),
                "notes": ANY_TEXT,
            }
        ),
        "provenance": _object(
            {"dataset": TEXT, "source_example_id": _maybe(ANY_TEXT), "created_at": TEXT, "license": TEXT}
        ),
    },
    {
        "contrast": _maybe(
            _object(
                {"paired_example_id": TEXT, "edit_role": _one_of(*EDIT_ROLES), "original_span": SPAN, "replacement_span": SPAN}
            )
        )
    },
)
_MOMENT = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|[+-](\d\d):(\d\d))", re.ASCII)
#: Spans of whole floats pass the structure and fail as spans, so they read as null here.
SPAN_DDL = "struct<start:int,end:int>"
RECORD_DDL = f"""
schema_version string, example_id string, family_id string, split string, claim string, label string,
domain string, fact_type string, prior_familiarity string,
knowledge_audit struct<checkpoint:string,status:string,audit_version:string,recognition_top1_rate:double,
 cloze_recall_exact_rate:double,forward_top1_rate:double,median_correct_probability:double,
 median_logprob_margin:double,recognition_passed:boolean,passed:boolean,model_revision:string,
 candidate_sha256:string,audited_at:string>,
claim_origin struct<kind:string,author:string,generator_model:string,generator_prompt_id:string>,
evidence_condition string,
evidence_sets array<struct<evidence_id:string,stance:string,text:string,source:struct<title:string,
 url_or_corpus_id:string,publisher:string,published_at:string,accessed_at:string,license:string>,
 retrieval_rank:int,retrieval_score:double,rationale_spans:array<{SPAN_DDL}>>>,
atomic_facts array<struct<atomic_id:string,text:string,label:string,claim_span:{SPAN_DDL}>>,
contrast struct<paired_example_id:string,edit_role:string,original_span:{SPAN_DDL},replacement_span:{SPAN_DDL}>,
annotations struct<annotator_ids:array<string>,agreement:double,adjudication_status:string,notes:string>,
provenance struct<dataset:string,source_example_id:string,created_at:string,license:string>"""


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def is_moment(value: str) -> bool:
    """Whether a string is an RFC 3339 date-time on the calendar; leap seconds aren't taken."""
    found = _MOMENT.fullmatch(value)
    if not found:
        return False
    year, month, day, hour, minute, second, off_hour, off_minute = (int(x or 0) for x in found.groups())
    if not (year and 1 <= month <= 12 and max(hour, off_hour) < 24 and max(minute, second, off_minute) < 60):
        return False
    return 1 <= day <= calendar.monthrange(year, month)[1]


def _within(value, least, most) -> bool:
    return (least is None or value >= least) and (most is None or value <= most)


def structure_errors(kind: tuple, value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, reason) of every place at which `value` is not of `kind`."""
    name, here = kind[0], path or "<row>"
    if name == "or null":
        if value is not None:
            yield from structure_errors(kind[1], value, path)
    elif name == "text":
        if not isinstance(value, str):
            yield here, "not a string"
        elif len(value) < kind[1]:
            yield here, "too short"
    elif name == "moment":
        if not isinstance(value, str):
            yield here, "not a string"
        elif not is_moment(value):
            yield here, "not a date-time"
    elif name == "one of":
        if not isinstance(value, str) or value not in kind[1]:
            yield here, "not an allowed value"
    elif name == "flag":
        if not isinstance(value, bool):
            yield here, "not a boolean"
    elif name == "number":
        if not _is_number(value):
            yield here, "not a number"
        elif not _within(value, kind[1], kind[2]):
            yield here, "out of range"
    elif name == "whole":
        if not _is_number(value) or (isinstance(value, float) and not value.is_integer()):
            yield here, "not an integer"
        elif not _within(value, kind[1], None):
            yield here, "out of range"
    elif name == "list":
        if not isinstance(value, list):
            yield here, "not an array"
            return
        if len(value) < kind[2]:
            yield here, "too few items"
        for i, item in enumerate(value):
            yield from structure_errors(kind[1], item, f"{path}.{i}".lstrip("."))
    else:
        if not isinstance(value, dict):
            yield here, "not an object"
            return
        for key in kind[1]:
            if key not in value:
                yield here, f"missing key {key}"
        for key, item in value.items():
            inner = kind[1].get(key) or kind[2].get(key)
            if inner is None:
                yield here, f"unknown key {key}"
            else:
                yield from structure_errors(inner, item, f"{path}.{key}".lstrip("."))


def schema_of(kind: tuple) -> dict:
    """The JSON Schema of a kind; `compiled` reads it back."""
    name = kind[0]
    if name == "or null":
        inner = schema_of(kind[1])
        return inner | {"type": [inner["type"], "null"]}
    if name == "one of":
        return {"type": "string", "enum": list(kind[1])}
    if name in ("text", "moment", "flag"):
        more = {"text": {"minLength": kind[-1]}, "moment": {"format": "date-time"}, "flag": {}}[name]
        return {"type": "boolean" if name == "flag" else "string"} | more
    if name in ("number", "whole"):
        bounds = dict(zip(("minimum", "maximum"), kind[1:], strict=False))
        return {"type": "number" if name == "number" else "integer"} | {k: v for k, v in bounds.items() if v is not None}
    if name == "list":
        return {"type": "array", "items": schema_of(kind[1]), "minItems": kind[2]}
    both = kind[1] | kind[2]
    return {"type": "object", "additionalProperties": False, "required": list(kind[1]), "properties": {k: schema_of(v) for k, v in both.items()}}


#: The keywords that each type may have; others, and types not here, are refused.
_KEYWORDS = {
    "string": {"minLength", "format", "enum", "const"},
    "boolean": set(),
    "number": {"minimum", "maximum"},
    "integer": {"minimum"},
    "array": {"items", "minItems"},
    "object": {"additionalProperties", "required", "properties"},
}


def compiled(schema: dict, definitions: dict | None = None) -> tuple:
    """The kind that a JSON Schema describes; ValueError for what kinds can't express.

    Objects have to be closed. Of references only those into `$defs` are followed.
    """
    if not isinstance(schema, dict):
        raise ValueError("schema is not an object")
    definitions = schema.get("$defs", {}) if definitions is None else definitions
    schema = {k: v for k, v in schema.items() if k not in ("$schema", "$id", "$defs", "title", "description")}
    if "$ref" in schema:
        name = str(schema["$ref"]).removeprefix("#/$defs/")
        if name not in definitions or set(schema) != {"$ref"}:
            raise ValueError(f"schema has a reference that leads nowhere: {schema['$ref']}")
        return compiled(definitions[name], {k: v for k, v in definitions.items() if k != name})
    kinds = schema.pop("type", "string" if schema.keys() & {"enum", "const"} else None)
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if "null" in kinds:
        (kind,) = [k for k in kinds if k != "null"] or [None]
        given = {"enum": [v for v in schema["enum"] if v is not None]} if "enum" in schema else {}
        return _maybe(compiled({"type": kind} | schema | given, definitions))
    (kind,) = kinds if len(kinds) == 1 else [None]
    if kind not in _KEYWORDS or not schema.keys() <= _KEYWORDS[kind]:
        raise ValueError(f"schema has a type or keyword that isn't known: {kind}, {sorted(schema)}")
    if kind == "string":
        if "format" in schema and schema["format"] != "date-time":
            raise ValueError(f"schema has a format that isn't known: {schema['format']}")
        values = schema.get("enum", [schema["const"]] if "const" in schema else None)
        if values is not None and not (isinstance(values, list) and all(isinstance(v, str) for v in values)):
            raise ValueError("schema has a choice among other values than strings")
        return _one_of(*values) if values is not None else ("moment",) if "format" in schema else ("text", schema.get("minLength", 0))
    if kind in ("boolean", "number", "integer"):
        low, high = schema.get("minimum"), schema.get("maximum")
        return {"boolean": FLAG, "number": ("number", low, high), "integer": ("whole", low)}[kind]
    if kind == "array":
        return _list(compiled(schema.get("items"), definitions), schema.get("minItems", 0))
    required, fields = schema.get("required", []), schema.get("properties", {})
    if schema.get("additionalProperties") is not False or not isinstance(fields, dict) or not set(required) <= set(fields):
        raise ValueError("schema has an object that is open or requires what it doesn't describe")
    inner = {k: compiled(v, definitions) for k, v in fields.items()}
    return _object({k: inner[k] for k in fields if k in required}, {k: inner[k] for k in fields if k not in required})


def load_schema(path: str | None = None) -> tuple:
    """The record format: of a JSON Schema file, or the packaged one without a path; ValueError if the file
    is missing or isn't a schema of records."""
    if path is None:
        return RECORD
    try:
        found = compiled(json.loads(Path(path).read_text(encoding="utf-8")))
    except (OSError, json.JSONDecodeError) as reason:
        raise ValueError(f"no readable schema at {path}") from reason
    if found[0] != "object":
        raise ValueError("the schema of records is not that of an object")
    return found


def _sound(text: str) -> str:
    """`text` with lone surrogates, which UTF-8 can't hold, as question marks."""
    return text.encode("utf-8", "replace").decode()


def checked_line(raw: str, kind: tuple = RECORD) -> tuple[str, list[str]]:
    """The line, rewritten in ASCII where it is a record, and what its structure lacks; never an exception.

    Beside bad syntax, a line is invalid that nests deeper or has longer integers than the parser takes,
    or a string that isn't Unicode text (half of a surrogate pair).
    """
    try:
        value = json.loads(raw)
        found = [_sound(f"{path}: {reason}") for path, reason in sorted(structure_errors(kind, value))]
        if found:
            return raw, found
        json.dumps(value, ensure_ascii=False).encode()
        return json.dumps(value), []
    except RecursionError:
        return raw, ["invalid JSON: nested too deeply"]
    except UnicodeEncodeError:
        return raw, ["invalid JSON: half of a surrogate pair"]
    except json.JSONDecodeError as reason:
        return raw, [_sound(f"invalid JSON: {reason.msg}")]
    except ValueError:
        return raw, ["invalid JSON: integer of too many digits"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_number (from 1 in each file, blank lines counted) and raw of every line that isn't blank.

    Files are read in splits. Lines of a split are numbered as they are read; one row for each split tells
    how many lines come before it in its file, so no line is shuffled.
    """
    lines = spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("raw"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # four numbers for each split, of the size that files are read in
    numbered = lines.join(F.broadcast(splits), ["file", "block"])
    return numbered.select((F.col("base") + F.col("seq") - F.col("first") + 1).alias("line_number"), "raw").filter(
        ~F.col("raw").rlike(r"\A[\s\x1c-\x1f\x85\p{Z}]*\z")
    )


def checked_lines(lines: DataFrame, kind: tuple = RECORD) -> DataFrame:
    """Lines with `errors`, an array of what their structure lacks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [checked_line(raw, kind) for raw in batch.column("raw").to_pylist()]
            made = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("line_number"), *made], ["line_number", "raw", "errors"])

    return lines.select("line_number", "raw").mapInArrow(check, "line_number long, raw string, errors array<string>")


def typed_records(checked: DataFrame) -> DataFrame:
    """line_number and the typed columns of the lines without structural errors."""
    good = checked.filter(F.size("errors") == 0)
    return good.select("line_number", F.from_json("raw", RECORD_DDL).alias("r")).select("line_number", "r.*")


def scoring_view(records: DataFrame) -> DataFrame:
    """The 13 fields that scoring needs."""
    plain = ("example_id", "family_id", "split", "claim", "label", "domain", "fact_type", "prior_familiarity", "evidence_condition")
    return records.select(
        *plain,
        F.col("evidence_sets.text").alias("evidence_texts"),
        F.col("contrast.paired_example_id").alias("paired_example_id"),
        F.col("knowledge_audit.status").alias("knowledge_status"),
        F.col("knowledge_audit.passed").alias("knowledge_passed"),
    )


def evidence_for_arm(texts, arm):
    """The evidence text of an arm: none for `prior`, all joined for `supplied_evidence`; else an error."""
    missing = F.raise_error(F.lit("supplied_evidence arm has no evidence")).cast("string")
    return (
        F.when(arm == "prior", F.lit(""))
        .when((arm == "supplied_evidence") & (F.size(texts) > 0), F.array_join(texts, "\n\n"))
        .when(arm == "supplied_evidence", missing)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported evidence arm: "), arm)).cast("string"))
    )


def load_records(spark: SparkSession, path: str, schema_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed records, scoring view) of a file; ValueError with the first 20 violations otherwise, and
    FileNotFoundError without a file."""
    from claimlens.operators.validation import cross_row_violations, require_valid, semantic_violations

    kind = load_schema(schema_path)
    try:
        lines = read_lines(spark, path)
    except AnalysisException as reason:
        if reason.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no records at {path}") from reason
    checked = checked_lines(lines, kind).persist()
    try:
        records = typed_records(checked)
        structural = checked.select("line_number", F.lit("structure").alias("rule"), F.explode("errors").alias("message"))
        require_valid(structural.unionByName(semantic_violations(records)).unionByName(cross_row_violations(records)))
        if records.isEmpty():
            raise ValueError("dataset contains no records")
    finally:
        checked.unpersist()
    return records, scoring_view(records)


def read_mask_plan(spark: SparkSession, path: str) -> DataFrame:
    """One row for each request of a fixed-mask plan, with the plan's mask token id."""
    plan = spark.read.json(path, multiLine=True)
    wrong = plan.filter(F.coalesce(F.col("fixture_kind") != "synthetic-correctness-smoke", F.lit(True)))
    if not wrong.isEmpty():
        raise ValueError("unexpected kind of mask plan")
    return plan.select("mask_token_id", F.explode("requests").alias("r")).select("mask_token_id", "r.*")


def read_marginals(spark: SparkSession, path: str) -> DataFrame:
    """request_id, position, target_id, probabilities; the statistics expected of a position, where the
    file has them, as columns expected_*."""
    found = spark.read.parquet(path)
    kinds = {"request_id": "string", "position": "int", "target_id": "int", "probabilities": "array<double>"}
    lacking = kinds.keys() - set(found.columns)
    if lacking:
        raise ValueError(f"marginals lack columns: {sorted(lacking)}")
    expected = [c for c in found.columns if c.startswith("expected_")]
    return found.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], *expected)


def attach_examples(requests: DataFrame, examples: DataFrame) -> DataFrame:
    """Requests with the metadata of their example; `mismatch` where it is missing or its claim differs."""
    meta = examples.select("example_id", "family_id", "split", "label", "paired_example_id", "claim")
    joined = requests.join(meta, "example_id", "left")
    return joined.withColumn("mismatch", ~F.col("claim").eqNullSafe(F.col("text")))
