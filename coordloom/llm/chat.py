"""Chat formatting by prefix-target expansion, in Spark SQL functions alone.

A turn is written as ``### role: text``, a line break, ``</turn>`` and a line break.
In texts and roles a backslash becomes two, ``###`` becomes ``\\h`` and ``</turn>``
becomes ``\\t``; in roles ``:`` becomes ``\\c`` as well. So neither mark can occur inside
a turn, and undoing the escapes gives back every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPES = (("###", "\\h"), ("</turn>", "\\t"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))
_TURN_END = "\n</turn>\n"
TRAINED_ROLE = "assistant"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, escapes=_ESCAPES) -> Column:
    """Text with backslashes doubled and control strings replaced."""
    out = _replace(text, "\\", "\\\\")
    for plain, coded in escapes:
        out = _replace(out, plain, coded)
    return out


def unescape(text: Column, escapes=_ESCAPES) -> Column:
    """The text that :func:`escape` was given."""
    def part(x: Column) -> Column:
        for plain, coded in escapes:
            x = _replace(x, coded, plain)
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """One example for each assistant turn: all turns before it, then the reply.

    Columns: ``conv``, ``target`` (place of the reply in its conversation, from 0),
    ``text``, and ``loss_start`` and ``loss_chars``, the code points of ``text`` that are
    trained on, which are the reply alone. Where turns follow the last reply, or there is
    none, one more row with a null ``target`` and no trained characters holds the whole
    conversation, so that no turn is lost.

    Turns are taken in the order of ``turn`` (nulls first), equal ones by role and text;
    repeated rows stay repeated turns. Null texts and roles count as empty; rows with a
    null ``conv`` form one conversation; other columns are left out. The shuffle moves
    each turn once; a prefix is cut from its conversation only after that, row by row,
    so a task holds one conversation and not its prefixes.
    """
    row = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = row.select("conv", F.struct(
        "turn", "role", "text",
        F.concat(F.lit("### "), escape(F.col("role"), _ROLE_ESCAPES), F.lit(": ")).alias("head"),
        escape(F.col("text")).alias("body")).alias("t"))
    whole = row.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    sizes = F.transform("t", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(_TURN_END))
    whole = whole.select(
        "conv",
        F.array_join(F.transform("t", lambda t: F.concat(
            t["head"], t["body"], F.lit(_TURN_END))), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(
            (t["role"] == TRAINED_ROLE).alias("trained"), F.length(t["head"]).alias("head"),
            F.length(t["body"]).alias("body"))).alias("shape"),
        # Ends of the turns in the formatted text, as a running sum.
        F.aggregate(sizes, F.array(F.lit(0)), lambda ends, n: F.concat(
            ends, F.array(F.element_at(ends, -1) + n))).alias("ends"))
    ranges = F.transform("shape", lambda s, k: F.struct(
        k.alias("target"), s["trained"].alias("trained"),
        (F.get("ends", k) + s["head"]).alias("start"), s["body"].alias("chars"),
        F.get("ends", k + 1).alias("end")))
    chosen = F.filter(ranges, lambda r: r["trained"] | (r["target"] == F.size("shape") - 1))
    one = whole.select("conv", "formatted", F.explode(chosen).alias("r"))
    return one.select(
        F.col("conv").alias(conv),
        F.when(F.col("r.trained"), F.col("r.target")).alias("target"),
        F.substring(F.col("formatted"), F.lit(1), F.col("r.end")).alias("text"),
        F.col("r.start").alias("loss_start"),
        F.when(F.col("r.trained"), F.col("r.chars")).otherwise(0).alias("loss_chars"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    parts = F.split(text, _TURN_END)
    def read(p: Column) -> Column:
        cut = F.instr(p, ": ")
        return F.struct(
            unescape(F.substring(p, F.lit(5), cut - 5), _ROLE_ESCAPES).alias("role"),
            unescape(F.substring(p, cut + 2, F.length(p))).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), read)


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, read back from their texts.

    ``n_turns`` and ``turns_sha256`` come from the longest example, which has every turn;
    ``loss_chars`` and ``loss_sha256`` from the trained characters of all examples in
    order; ``formatted_chars`` adds up the lengths of the examples.
    """
    loss = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars"))
    read = formatted.select(
        F.col(conv).alias("conv"), "text", F.length("text").alias("chars"),
        F.when(F.col("target").isNotNull(), F.struct(
            "target", unescape(loss).alias("loss"))).alias("reply"))
    whole = read.groupBy("conv").agg(
        F.max_by("text", "chars").alias("text"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list("reply")).alias("replies"))
    trained = F.array_join(F.transform("replies", lambda r: r["loss"]), "")
    return whole.select("conv", "formatted_chars", turns_of(F.col("text")).alias("turns"),
                        trained.alias("loss")).select(
        F.col("conv").alias(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
        .alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
