"""Preference formatting for chat pairs, with DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered
once, as the prompt; what follows is rendered as two completions. A completion's mask
lists the spans (code points) to train on: the words and end mark of assistant turns.

Defined results: turns are ordered by turn, role and text, so ties are settled alike
everywhere; a null role or text counts as empty; equal conversations give a full
prompt and empty completions; a conversation without an assistant turn has nothing to
prefer and gives no pair; markers inside a text are broken up. A conversation is one
value of the result, so it must fit a row; there is no other group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
END = "<|end|>\n"


def header(role: Column | str) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered(turns: Column) -> Column:
    """The turns (``role``, ``text``) as one string."""
    parts = F.transform(turns, lambda t: F.concat(header(t["role"]), t["text"], F.lit(END)))
    return F.array_join(parts, "")


def mask(turns: Column) -> Column:
    """Spans ``s, e`` of the rendered turns that are trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s: int, e: int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        s = state["at"] + F.length(header(t["role"]))
        e = s + F.length(t["text"]) + len(END)
        span = F.array(F.struct(s.alias("s"), e.alias("e")))
        spans = F.when(t["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(e.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda state: state["spans"])


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key`` and ``turns``: one row per conversation, its turns in order."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), _plain(F.col("text").cast("string")).alias("text"))
    return turns.groupBy(turns[key].alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def with_earlier_reply(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, chosen, rejected``: a conversation up to its last assistant turn, and the
    same with that reply replaced by the assistant's reply before it; where there is
    none, by an echo of the turn before."""
    turns = F.col("turns")
    flags = F.transform(turns, lambda t: t["role"] == ASSISTANT)
    last = F.size(turns) + 1 - F.array_position(F.reverse(flags), True).cast("int")
    convs = convs.filter(F.array_contains(flags, True)).withColumn("last", last)
    before = F.slice(turns, F.lit(1), F.col("last") - 1)
    convs = convs.select(key, "last", "turns", before.alias("before"))
    replies = F.filter("before", lambda t: t["role"] == ASSISTANT)
    reply = F.coalesce(F.try_element_at(replies, F.lit(-1)), F.try_element_at("before", F.lit(-1)))
    final = F.element_at("turns", F.col("last"))
    instead = F.struct(
        final["turn"].alias("turn"), final["role"].alias("role"), F.coalesce(reply["text"], F.lit("")).alias("text")
    )
    return convs.select(
        key,
        F.concat("before", F.array(final)).alias("chosen"),
        F.concat("before", F.array(instead)).alias("rejected"),
    )


def format_preferences(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """From ``key, chosen, rejected`` (arrays of ``turn, role, text``): ``n_common`` turns,
    the ``prompt``, and ``chosen``, ``rejected`` with their masks. No shuffle."""
    same = F.zip_with(
        "chosen",
        "rejected",
        lambda a, b: a.isNotNull()
        & b.isNotNull()
        & a["role"].eqNullSafe(b["role"])
        & a["text"].eqNullSafe(b["text"]),
    )
    first_other = F.array_position(same, False).cast("int")
    n_common = F.when(first_other == 0, F.size(same)).otherwise(first_other - 1)
    pairs = pairs.select(key, "chosen", "rejected", n_common.alias("n_common"))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    pairs = pairs.select(
        key,
        "n_common",
        F.slice("chosen", F.lit(1), F.col("n_common")).alias("common"),
        rest("chosen").alias("chosen"),
        rest("rejected").alias("rejected"),
    )
    return pairs.select(
        key,
        "n_common",
        rendered(F.col("common")).alias("prompt"),
        rendered(F.col("chosen")).alias("chosen"),
        mask(F.col("chosen")).alias("chosen_mask"),
        rendered(F.col("rejected")).alias("rejected"),
        mask(F.col("rejected")).alias("rejected_mask"),
    )


def spans_text(spans: str) -> Column:
    """Spans as ``s-e,s-e``."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["s"], x["e"])), ",")
