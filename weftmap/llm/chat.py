"""Chat formatting (DataFrame functions only).

Template: a block for each run of turns of one role, ``<s>`` role ``\\n`` text
(``<sep/>`` text)* ``</s>``. In texts and roles ``\\`` becomes ``\\e``, ``<``
``\\l`` and ``[`` ``\\b`` (in roles also a newline ``\\n``), so no control string,
of this template or of others like ``[INST]``, can come from a text, and the
text can be read back. The loss mask covers the texts of assistant turns.

A conversation's rows are collected as structs and sorted; each turn is marked as the
first of a block or as one more of its role, folds over the array put the pieces in
their places, and these are concatenated. The folds go by chunks of ``CHUNK`` turns,
so that what they append to stays short and a conversation of n turns doesn't cost n
squared copies.

Defined results: rows of a conversation are ordered by turn (null first), then
role and text, so ties and repeated rows have one order; null roles and texts
are empty; rows with a null conv_id form one conversation; columns other than
conv_id, turn, role and text take no part. A conversation is one value of the
result, so its turns meet in one row; its size is that of the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<s>", "<sep/>", "</s>"
LOSS_ROLE = "assistant"
CHUNK = 128
_PIECES = "array<struct<piece:string,start:bigint,length:bigint,loss:boolean>>"


def escape(text: Column, role: bool = False) -> Column:
    for a, b in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")) + ((("\n", "\\n"),) if role else ()):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for a, b in ((("\n", "\\n"),) if role else ()) + (("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _marked(turns: Column) -> Column:
    """For each turn its text with what comes before it: a block's head where the role changes, a separator where it doesn't."""

    def of(t: Column, i: Column) -> Column:
        before = F.get(turns, i - 1)["role"]
        begin = F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(CLOSE)), F.lit(OPEN), escape(t["role"], True), F.lit("\n"))
        return F.struct(F.when((i > 0) & (before == t["role"]), F.lit(SEP)).otherwise(begin).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss"))

    return F.transform(turns, of)


def _merged(parts: Column) -> Column:
    """The pieces of the text, each with the place of its turn's own text: folds over chunks, from the bytes before each chunk."""
    size = lambda p: F.octet_length(p["head"]).cast("long") + F.octet_length(p["body"])
    places = lambda k: F.sequence(k, F.least(k + CHUNK, F.size(parts)) - 1)
    chunks = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(CHUNK))
    total = lambda k: F.aggregate(places(k), F.lit(0).cast("long"), lambda a, i: a + size(F.get(parts, i)))
    begin = F.struct(F.lit(0).cast("long").alias("done"), F.array().cast("array<bigint>").alias("before"))

    def step(a: Column, i: Column) -> Column:
        p = F.get(parts, i)
        piece = F.struct(F.concat(p["head"], p["body"]).alias("piece"), (a["done"] + F.octet_length(p["head"]) + 1).alias("start"), F.octet_length(p["body"]).cast("long").alias("length"), p["loss"].alias("loss"))
        return F.struct((a["done"] + size(p)).alias("done"), F.concat(a["pieces"], F.array(piece)).alias("pieces"))

    def fold(before: Column) -> Column:
        first = lambda c: F.struct(F.get(before, c).alias("done"), F.array().cast(_PIECES).alias("pieces"))
        return F.flatten(F.transform(chunks, lambda k, c: F.aggregate(places(k), first(c), step)["pieces"]))

    sums = lambda sizes: F.aggregate(sizes, begin, lambda a, n: F.struct((a["done"] + n).alias("done"), F.concat(a["before"], F.array(a["done"])).alias("before")))["before"]
    return _let(sums(F.transform(chunks, total)), fold)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the text of each conversation, and start (from 1) and length of its masked parts, in bytes of UTF-8, so that each is found without a walk over the text."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    met = rows.groupBy("conv_id").agg(F.collect_list("t").alias("t"))
    made = met.select("conv_id", _let(F.sort_array("t"), lambda t: _let(_marked(t), _merged)).alias("p"))
    return made.select(
        "conv_id",
        F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(CLOSE)).alias("formatted"),
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): the turns and the masked text that a formatted conversation holds."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    as_turns = lambda b: F.transform(
        F.split(F.substr(b, F.locate("\n", b) + 1), SEP, -1),
        lambda t: F.struct(unescape(F.substr(b, F.lit(len(OPEN) + 1), F.locate("\n", b) - len(OPEN) - 1), True).alias("role"), unescape(t).alias("text")),
    )
    masked = _let(F.encode(F.col("formatted"), "UTF-8"), lambda whole: F.transform("loss_spans", lambda s: unescape(F.decode(F.substr(whole, s["start"].cast("int"), s["length"].cast("int")), "UTF-8"))))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, as_turns)).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(back: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss_text"), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
