"""Relational chat formatting: sorted turn structs, merged same-role runs and text, in Spark expressions only.

Template: each run of turns of one role is ``### Role: `` + texts + `` </turn>`` + newline, where the
texts of merged turns are parted by `` <turn> ``.  Inside texts and roles every backslash becomes
``\\\\``, every ``<`` becomes ``\\l`` and every ``#`` becomes ``\\h``, so that no text can hold a
control string and the escaping can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, ROLE_END, PART, END = "### ", ": ", " <turn> ", " </turn>\n"


def escape(c: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    """The inverse of escape: texts are cut at escaped backslashes, so that none starts another escape."""
    plain = lambda s: F.replace(F.replace(s, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def _role_in(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\c"))


def _role_out(c: Column) -> Column:
    plain = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, blocks) from rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text; a null turn comes first.  Null text or role
    counts as empty; a null conv_id is a conversation of its own.  Repeated rows stay.  blocks:
    array of (role, texts) after merging adjacent turns of one role; the loss mask covers exactly
    the texts of blocks whose role is ``assistant``.  Extra columns are ignored.  One shuffle, on
    conv_id; a conversation is one row of the result, so its turns meet in one row in any case.
    """
    s = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.select("conv_id", s.alias("s")).groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("ts"))
    n = F.size("ts")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]))
    convs = convs.withColumn("starts", starts)
    block = lambda a, k: F.struct(
        F.get("ts", a)["role"].alias("role"),
        F.transform(F.slice("ts", a + 1, F.coalesce(F.get("starts", k + 1), n) - a), lambda t: t["text"]).alias("texts"),
    )
    convs = convs.select("conv_id", F.transform("starts", block).alias("blocks"))
    shown = F.transform(
        "blocks",
        lambda b: F.concat(F.lit(HEAD), _role_in(b["role"]), F.lit(ROLE_END), F.array_join(F.transform(b["texts"], escape), PART), F.lit(END)),
    )
    return convs.select("conv_id", F.array_join(shown, "").alias("formatted"), "blocks")


def parse_formatted(formatted: Column) -> Column:
    """array of (role, text), read back from formatted text: one entry for each turn."""
    body = F.filter(F.split(formatted, r" </turn>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        at = F.instr(b, ROLE_END)
        role = _role_out(b.substr(F.lit(len(HEAD) + 1), at - 1 - len(HEAD)))
        rest = b.substr(at + len(ROLE_END), F.length(b))
        return F.transform(F.split(rest, PART, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(body, turns))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and the digests that the formatted text alone gives (see llm.queries)."""
    df = formatted.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("back"))
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    df = df.withColumn("loss", loss)
    return df.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
