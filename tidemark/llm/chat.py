"""Chat formatting with Spark expressions.

The turns of a conversation are collected as structs and sorted. Adjacent turns
of one role share a block; the pieces are concatenated in one array pass:

    ### role
    text<part>text of the next turn of the same role</turn>

Inside roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l``, ``#``
becomes ``\\h`` and, in roles, a line feed ``\\n``. So no text can hold a marker,
each backslash is followed by one of these letters, and the escape is undone by
plain replacement. The loss mask is a list of spans (code points, end exclusive)
of the formatted string, one for each text of the trained role.

Defined cases: a null text or role is empty; null turns sort first; turns of
equal number sort by role and text; rows without conv_id are one conversation;
repeated rows are turns of their own; no rows give no conversations. Extra
columns are not read. A conversation is one row of the result, so it has to fit
into one string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
PART, END = "<part>", "</turn>\n"
TRAINED = "assistant"
_RUN = 256


def _replace(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(text: Column) -> Column:
    """Make ``text`` free of markers; ``unescape`` undoes it."""
    return _replace(text, _ESCAPES)


def unescape(text: Column) -> Column:
    """Undo ``escape``: the backslash itself comes last."""
    return _replace(text, [(b, a) for a, b in reversed(_ESCAPES)])


def _prefix_sums(values: Column) -> Column:
    """Inclusive sums of an array, by runs, so that long arrays stay cheap."""
    n = F.size(values)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int")), lambda r: total(F.slice(values, r * _RUN + 1, F.lit(_RUN))))
    bases = F.aggregate(
        runs,
        F.array(F.lit(0).cast("long")),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(bases, F.floor(i / _RUN).cast("int")) + total(F.slice(values, F.floor(i / _RUN).cast("int") * _RUN + 1, i % _RUN + 1)),
    )


def format_conversations(rows: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation."""
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def lead(t: Column, i: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))
        opening = F.concat(F.lit("### "), role, F.lit("\n"))
        last = F.get(F.col("ts"), i - 1)
        return F.when(i == 0, opening).when(last["role"] == t["role"], F.lit(PART)).otherwise(F.concat(F.lit(END), opening))

    pieces = F.transform(F.col("ts"), lambda t, i: F.struct(lead(t, i).alias("lead"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("loss")))
    chats = chats.select("conv_id", pieces.alias("ps"))
    chats = chats.withColumn("ends", _prefix_sums(F.transform("ps", lambda p: (F.length(p["lead"]) + F.length(p["body"])).cast("long"))))
    spans = F.transform(
        F.filter(F.arrays_zip("ps", "ends"), lambda z: z["ps"]["loss"]),
        lambda z: F.struct((z["ends"] - F.length(z["ps"]["body"])).alias("start"), z["ends"].alias("end")),
    )
    whole = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END))
    return chats.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.split(F.left(formatted, F.length(formatted) - len(END)), END, -1)

    def turns(block: Column) -> Column:
        cut = F.locate("\n", block)
        role = unescape(F.replace(F.substring(block, F.lit(5), cut - 5), F.lit("\\n"), F.lit("\n")))
        body = F.split(F.substring(block, cut + 1, F.length(block)), PART, -1)
        return F.transform(body, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id and what can be read back from each formatted conversation."""
    read = chats.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
