"""Preference formatting: one shared prompt and two masked completions for each pair of conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written. ``guard`` replaces ``mark`` inside roles and texts, so that no text can end a turn."""

    begin: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    mark: str = "<|"
    guard: str = "< |"
    trained_role: str = "assistant"

    def head(self, role: Column) -> Column:
        before, after = self.begin.split("{role}")
        return F.concat(F.lit(before), role, F.lit(after))

    def clean(self, value: Column) -> Column:
        return F.replace(F.coalesce(value, F.lit("")), F.lit(self.mark), F.lit(self.guard))


def turns_of(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, template: Template) -> DataFrame:
    """``(id, turns)``: each conversation's turns in order, ties by role and text."""
    role, text = template.clean(F.col(role_col).cast("string")), template.clean(F.col(text_col).cast("string"))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    return conversations.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns in the longest common prefix; role and text count, not the turn's number."""
    both = F.zip_with(a, b, lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first = F.array_position(both, False)
    return F.when(first > 0, first - 1).otherwise(F.size(both)).cast("int")


def rendered(turns: Column, template: Template) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(template.head(t.role), t.text, F.lit(template.end))), "")


def trained_spans(turns: Column, template: Template) -> Column:
    """``(start, length)`` in code points of what counts in training: texts of the trained role with their end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        head = F.length(template.head(t.role))
        body = F.length(t.text) + len(template.end)
        span = F.array(F.struct((state.at + head).alias("start"), body.alias("length")))
        return F.struct(
            (state.at + head + body).alias("at"), F.when(t.role == template.trained_role, F.concat(state.spans, span)).otherwise(state.spans).alias("spans")
        )

    return F.aggregate(turns, start, step, lambda s: s.spans)


def format_preferences(
    conversations: DataFrame, pair: Column, chosen: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", template: Template | None = None,
) -> DataFrame:
    """``(pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans)``, one row per complete pair.

    ``pair`` and ``chosen`` are conditions on the id column ``id``: the pair a conversation belongs to and whether it
    is the preferred side. The longest common prefix of turns is rendered once as prompt; what follows on
    either side is a completion, empty if that side has nothing more. Spans mark, per completion,
    the code points to train on; prompts and other roles stay masked. Where several
    conversations are the same side of a pair, the one with the smallest id is taken.

    A null text or role is empty, turns with equal numbers go by role and text, repeated rows
    repeat a turn, rows with a null id or pair are left out, and so is a pair without one of its
    sides. Other columns are ignored; an empty table gives no rows. A conversation is assembled in one
    row, so it is the only thing here that must fit a task.
    """
    template = template or Template()
    sides = turns_of(conversations, id_col, turn_col, role_col, text_col, template).select(pair.alias("pair_id"), chosen.alias("side"), "id", "turns")
    sides = sides.where(F.col("pair_id").isNotNull() & F.col("side").isNotNull())
    first = F.struct("id", "turns")
    paired = sides.groupBy("pair_id").agg(F.min(F.when(F.col("side"), first)).alias("c"), F.min(F.when(~F.col("side"), first)).alias("r"))
    paired = paired.where(F.col("c").isNotNull() & F.col("r").isNotNull())
    paired = paired.select("pair_id", F.col("c.turns").alias("c"), F.col("r.turns").alias("r")).withColumn("prompt_turns", common_turns(F.col("c"), F.col("r")))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("prompt_turns") + 1, F.size(side))

    return paired.select(
        "pair_id", "prompt_turns", rendered(F.slice("c", F.lit(1), F.col("prompt_turns")), template).alias("prompt"),
        rendered(rest("c"), template).alias("chosen"), rendered(rest("r"), template).alias("rejected"),
        trained_spans(rest("c"), template).alias("chosen_spans"), trained_spans(rest("r"), template).alias("rejected_spans"),
    )
