"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all preceding turns are context and only that reply is trainable. Turns after
the last reply (or a conversation without replies) come as one more example with nothing trainable, so no turn is lost.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&`` is written ``&amp;`` and ``<|`` is
written ``&lt;|`` (in roles also a newline as ``&nl;``), so no text can form a control string, and ``unescaped`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def _unrole(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def examples(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trainable: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (0, 1, ...), formatted, loss_start (code points, from 0), loss_length.

    Turns are ordered by turn, then role and text; repeated rows all stay; null role or text is empty; null turns come
    first; rows with a null conv_id form one conversation. Other columns are not read; no rows give no examples.
    """
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # each turn's head, body and whether it is a target; then per target the turns before it
    marked = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == trainable).alias("target"))).alias("turns"),
    )
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("turns", i)["target"] | (i == last))
    each = marked.select("conv_id", "turns", F.posexplode(ends).alias("example", "n"))
    final = F.element_at("turns", F.col("n"))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n") - 1), whole), "")
    laid = each.select("conv_id", "example", context.alias("context"), final.alias("final"))
    return laid.select(
        "conv_id",
        "example",
        F.concat("context", "final.head", "final.body", F.lit(f"{END}\n")).alias("formatted"),
        (F.length("context") + F.length("final.head")).cast("long").alias("loss_start"),
        F.when(F.col("final.target"), F.length("final.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, parsed back: array<struct<role, text>>."""
    bodies = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s: s != "")
    cut = lambda s: F.call_function("instr", s, F.lit("\n"))
    return F.transform(bodies, lambda s: F.struct(_unrole(F.substring(s, F.lit(1), cut(s) - 1)).alias("role"), unescaped(F.substring(s, cut(s) + 1, F.length(s) - cut(s) - (len(END) + 1))).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what the examples hold, read back from them."""
    loss = unescaped(F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    per = formatted.select("conv_id", "example", "formatted", loss.alias("loss"), F.length("formatted").alias("chars"))
    convs = per.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("longest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
    turns = convs.withColumn("turns", turns_of(F.col("longest")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
