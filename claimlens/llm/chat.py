r"""Chat formatting of messages with typed content parts.

A message has a list of parts, each text, image, audio or document. A visitor over the parts writes
text with its control strings escaped and every attachment as a numbered placeholder in reading
order, and records the attachment's reference and how many tokens it expands to. Turns are then
joined by conversation:

    <turn>role\ntext</turn>\n

Escapes: `\` becomes `\b`, the `<` of a control string `\l` and a line end in a role `\n`. Every
backslash of the output is thus followed by its code, so undoing `\b` last restores any text.

Defined cases: null role or text is empty; unknown part types are treated as documents; a conversation
without assistant turns has an empty loss mask; equal turn numbers are ordered by role, then by content, and repeated
rows stay; a null conversation id is a conversation of its own. Columns besides these don't enter.
A conversation becomes one string, so its own length bounds the row that holds it; turns are already
formatted when they meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
#: What an attachment of a type expands to where it doesn't say itself.
TOKENS = {"image": 256, "audio": 150, "document": 512}
_CONTROL = r"<(?=/?turn>|(?:image|audio|document):)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), _CONTROL, r"\\l")


def unescaped(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("n_tokens"),
        )
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("")) == "text"


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("image", "audio"), part["type"]).otherwise("document")


def _expanded(part: Column) -> Column:
    default = F.lit(TOKENS["document"])
    for kind in ("image", "audio"):
        default = F.when(part["type"] == kind, TOKENS[kind]).otherwise(default)
    return F.coalesce(part["n_tokens"], default).cast("long")


def format_chats(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, parts: array<struct<type, text, ref, n_tokens>>).

    formatted: the whole string; spans: for each turn where it begins and where its content lies, in
    code points, half open, with `loss` true for assistants; attachments: number, type, ref and
    n_tokens of each placeholder; attachment_tokens: their sum.
    """
    listed = F.coalesce(F.col(parts), F.array().cast("array<struct<type:string,text:string,ref:string,n_tokens:bigint>>"))
    rows = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        listed.alias("parts"),
    )
    rows = rows.withColumn("own", F.filter("parts", lambda p: ~_is_text(p)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.to_json("parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn(
        "seen", F.coalesce(F.sum(F.size("own")).over(before), F.lit(0)).cast("int")
    )

    def placeholder(part: Column, i: Column) -> Column:
        number = F.col("seen") + F.size(F.filter(F.slice(F.col("parts"), 1, i + 1), lambda p: ~_is_text(p)))
        return F.concat(F.lit("<"), _kind(part), F.lit(":"), number.cast("string"), F.lit(">"))

    flat = F.transform(
        "parts",
        lambda p, i: F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p, i)),
    )
    attached = F.transform(
        "own",
        lambda p, i: F.struct(
            (F.col("seen") + i + 1).alias("number"),
            _kind(p).alias("type"),
            p["ref"].alias("ref"),
            _expanded(p).alias("n_tokens"),
        ),
    )
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    rows = (
        rows.withColumn("head_len", F.length(head))
        .withColumn("written", F.concat(head, F.array_join(flat, ""), F.lit(CLOSE)))
        .withColumn("attached", attached)
        .withColumn("begin", F.coalesce(F.sum(F.length("written")).over(before), F.lit(0)).cast("long"))
    )
    span = F.struct(
        F.col("begin").alias("turn_start"),
        (F.col("begin") + F.col("head_len")).alias("start"),
        (F.col("begin") + F.length("written") - len(CLOSE)).alias("end"),
        (F.col("role") == "assistant").alias("loss"),
    )
    joined = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "written", span.alias("span"), "attached"))).alias("turns")
    )
    return joined.select(
        "conv_id",
        F.array_join(F.col("turns.written"), "").alias("formatted"),
        F.col("turns.span").alias("spans"),
        F.flatten(F.col("turns.attached")).alias("attachments"),
    ).withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns: array<struct<role, text>> parsed from `formatted`, and loss_text from its spans.

    The string is split at turn ends once, so that reading stays linear in its length.
    """
    pieces = F.split("formatted", "(?<=</turn>\n)", -1)
    pieces = F.filter(pieces, lambda p: p != "")
    cut = formatted.withColumn("pieces", pieces)
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescaped(
                F.regexp_replace(F.regexp_replace(p, r"\A<turn>[^\n]*\n", ""), r"</turn>\n\z", "")
            ).alias("text"),
        ),
    )
    masked = F.zip_with(
        "pieces",
        "spans",
        lambda p, s: F.when(
            s["loss"],
            unescaped(F.substr(p, (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ).otherwise(""),
    )
    return cut.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation holds, as digests of what is read back from it."""
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
