"""Chat formatting by event sourcing (operator 9), in DataFrame functions only.

A log holds events ``conv_id, seq, message_id, kind, role, text``. ``message`` opens a message,
``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties it for the deltas that
follow. Events fold per message in order of ``seq`` (null first; ties by kind, role and text), and
messages line up by their first ``seq`` (ties by role and text). A null text or role is empty,
an unknown kind appends, a null ``conv_id`` is a conversation of its own, an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, CLOSE, END = "<s>[", "] ", "</s>"
# What starts or ends a mark never stands in an escaped text.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, seq, role, text``. The log moves once, by conversation."""
    filled = events.select(
        "conv_id", "message_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    resets = F.lit(["message", "edit"])
    grouped = filled.repartition("conv_id").groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    final = F.aggregate(
        "log", F.lit(""),
        lambda text, e: F.when(F.array_contains(resets, e["kind"]), e["text"])
        .when(e["kind"] == "regenerate", F.lit("")).otherwise(F.concat(text, e["text"])))
    return grouped.select("conv_id", F.col("log")[0]["seq"].alias("seq"),
                          F.col("log")[0]["role"].alias("role"), final.alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_mask``: the mask lists, per turn, the lengths in characters of
    the part before, under and after the loss (nothing is under it unless the role is ``learn``)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(CLOSE))
    turns = messages.select("conv_id", "seq", F.col("role").alias("plain"), head.alias("head"),
                            text.alias("body"))
    turns = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "plain", "head", "body"))).alias("turns"))
    formatted = F.array_join(
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")

    def lengths(t):
        learned = F.when(t["plain"] == learn, F.length(t["body"])).otherwise(F.lit(0))
        return F.struct(F.length(t["head"]).alias("before"), learned.alias("loss"),
                        (F.length(t["body"]) + len(END) - learned).alias("after"))
    return turns.select("conv_id", formatted.alias("formatted"),
                        F.transform("turns", lengths).alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns (role, text), loss_text`` parsed from the rendered strings."""
    parts = F.slice(F.split("formatted", END), 1, F.size("loss_mask"))
    cut = rendered.select("conv_id", "formatted", "loss_mask", parts.alias("parts"))

    def turn(part):
        close = F.instr(part, CLOSE)
        return F.struct(
            unescape(F.substring(part, F.lit(len(TURN) + 1), close - len(TURN) - 1)).alias("role"),
            unescape(F.substring(part, close + len(CLOSE), F.length(part))).alias("text"))
    loss = F.array_join(F.zip_with(
        "parts", "loss_mask", lambda p, m: F.substring(p, m["before"] + 1, m["loss"])), "")
    return cut.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"),
                      unescape(loss).alias("loss_text"))


def conversation_digests(parsed: DataFrame) -> DataFrame:
    line = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
