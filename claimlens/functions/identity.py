"""Content identities: SHA-256 over canonical JSON with sorted keys and no spaces.

Numbers are written as the shortest decimal with an exponent below 1e-4, as JSON writers of dynamic languages do. Java 17
may give one digit more than the shortest for some doubles outside everyday rates; equal doubles still
have equal identities.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The score-affecting fields.
STRING_FIELDS = (
    "scoring_protocol", "model_repository", "model_revision", "tokenizer_revision", "remote_code_revision",
    "arm", "prompt_protocol", "mask_policy", "dtype", "inference_backend",
)
LIST_FIELDS = ("input_ids", "attention_mask", "masked_positions", "target_ids")
NUMBER_FIELDS = ("mask_rate", "temperature")
WORK_FIELDS = tuple(sorted((*STRING_FIELDS, *LIST_FIELDS, *NUMBER_FIELDS)))
ANALYTIC = "analytic-v1"


def json_string(value: Column) -> Column:
    """A quoted JSON string; control characters take lower-case escapes."""
    quoted = F.to_json(F.array(value))
    quoted = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    # Jackson writes \\u001F; the canonical form is \\u001f
    for code in (*range(10, 16), *range(26, 32)):
        quoted = F.replace(quoted, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return quoted


def json_number(value: Column) -> Column:
    """A finite double as JSON."""
    text = value.cast("double").cast("string")
    mantissa, exponent = F.regexp_extract(text, r"^(-?[\d.]+)E", 1), F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"[.-]", "")
    sign = F.when(value < 0, F.lit("-")).otherwise("")
    short = F.regexp_replace(mantissa, r"\.0$", "")
    power = F.concat(F.when(exponent < 0, F.lit("-")).otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    point = exponent + 1
    whole = F.concat(F.rpad(F.substr(digits, F.lit(1), point), point, "0"), F.lit("."))
    rest = F.when(F.length(digits) > point, F.substr(digits, point + 1)).otherwise("0")
    return (
        F.when(~text.contains("E"), text)
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .when((exponent >= 7) & (exponent < 16), F.concat(sign, whole, rest))
        .otherwise(F.concat(short, F.lit("e"), power))
    )


def json_integers(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ","), F.lit("]"))


def json_value(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of any nesting: keys of structs sorted, no spaces, null as null.

    A number that isn't finite has none and gives NULL.
    """
    if isinstance(kind, T.StringType):
        made = json_string(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        made = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), json_number(value))
        return F.when(value.isNull(), F.lit("null")).otherwise(made)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        made = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: json_value(x, kind.elementType))
        # array_join leaves NULLs out, so one of them makes the whole NULL
        joined = F.when(F.forall(inner, lambda x: x.isNotNull()), F.array_join(inner, ","))
        return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(":"), json_value(value[f.name], f.dataType)) for f in fields]
        between = [x for p in parts for x in (F.lit(","), p)][1:]
        made = F.concat(F.lit("{"), *between, F.lit("}"))
    else:
        raise ValueError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(made)


def work_payload(fields: dict[str, Column]) -> Column:
    """Canonical JSON of the 16 score-affecting fields; the example is not among them."""
    written = {f: json_string(fields[f]) for f in STRING_FIELDS}
    written |= {f: json_integers(fields[f]) for f in LIST_FIELDS} | {f: json_number(fields[f]) for f in NUMBER_FIELDS}
    parts = [F.concat(F.lit(f'"{name}":'), written[name]) for name in WORK_FIELDS]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def work_id(fields: dict[str, Column]) -> Column:
    return F.sha2(work_payload(fields).cast("binary"), 256)


def work_errors(fields: dict[str, Column]) -> Column:
    """array<string> of the reasons for which fields have no identity."""
    inputs, attention, at, targets = (fields[f] for f in LIST_FIELDS)
    rate, temperature = fields["mask_rate"].cast("double"), fields["temperature"].cast("double")
    blank = F.lit(False)
    for name in STRING_FIELDS:
        blank = blank | F.coalesce(fields[name] == "", F.lit(True))
    no = lambda good: ~F.coalesce(good, F.lit(False))
    finite = ~F.isnan(temperature) & (temperature > 0) & (temperature < float("inf"))
    return F.array_compact(
        F.array(
            F.when(blank, F.lit("empty string field")),
            F.when(no((F.size(inputs) > 0) & (F.size(inputs) == F.size(attention))), F.lit("attention length")),
            F.when(no(F.forall(attention, lambda x: x.isin(0, 1))), F.lit("attention value")),
            F.when(no((F.size(at) > 0) & (F.size(at) == F.size(targets))), F.lit("target length")),
            F.when(no(F.size(F.array_distinct(at)) == F.size(at)), F.lit("repeated position")),
            F.when(no(F.forall(at, lambda x: (x >= 0) & (x < F.size(inputs)))), F.lit("position out of range")),
            F.when(no((rate > 0) & (rate <= 1)), F.lit("mask rate")),
            F.when(no(finite), F.lit("temperature")),
            F.when((fields["scoring_protocol"] == ANALYTIC) & no(temperature == 1.0), F.lit("analytic temperature")),
        )
    )


def ids_digest(ids: Column, final_newline: bool = True) -> Column:
    """Digest of an array of ids as sorted lines; for ids beyond what an array holds there is plan_digest."""
    lines = F.array_join(F.array_sort(ids), "\n")
    return F.sha2((F.concat(lines, F.lit("\n")) if final_newline else lines).cast("binary"), 256)


def plan_digest(plan: DataFrame, id_column: str = "work_id", final_newline: bool = False) -> str:
    """`ids_digest` of a whole plan of any size: sorted by the executors, and hashed on the driver line by line,
    with one partition there at a time."""
    digest, between = hashlib.sha256(), b""
    for row in plan.select(id_column).sort(id_column).toLocalIterator():
        digest.update(between + row[0].encode())
        between = b"\n"
    if final_newline:
        digest.update(b"\n")
    return digest.hexdigest()


def shard_statistics(rows: DataFrame, by: list[str], id_column: str = "work_id") -> DataFrame:
    """Per group: row_count, first and last id, whether ids repeat, and their digest."""
    ids = F.collect_list(id_column)
    return rows.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        F.min(id_column).alias("first_work_id"),
        F.max(id_column).alias("last_work_id"),
        (F.count(id_column) != F.count_distinct(id_column)).alias("has_duplicates"),
        ids_digest(ids).alias("work_ids_sha256"),
    )
