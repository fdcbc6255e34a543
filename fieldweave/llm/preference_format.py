"""Preference pairs from chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns (equal role and text, place by place) is rendered once as the
prompt; what follows it in each conversation is a completion. A mask gives the character ranges of a
completion that are trained on: the assistant's texts with their end marks.

A turn is rendered as ``<|role|>``, a line break, its text, ``<|end|>`` and a line break. Null role or
text counts as empty; turns with equal numbers are taken by role and text, repeated rows are repeated
turns; a conversation that is missing has no turns, so its pair has an empty prompt and an empty completion on that side (none is dropped); rows without a pair are left out; an empty table
gives an empty result; other columns are ignored. Turns of a pair come together in one row: this is
one training example, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import table

_END = "<|end|>"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(_END + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Ranges start-end of assistant turns in the rendered turns, joined by semicolons."""

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + 5
        span = F.concat_ws("-", start, start + F.length(turn["text"]) + len(_END))
        spans = F.when(turn["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(_rendered(turn))).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    return F.aggregate(turns, start, add, lambda state: F.array_join(state["spans"], ";"))


def format_preferences(turns: DataFrame, pair: Column, is_chosen: Column, turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask for each pair."""
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(role_column, F.lit("")).alias("role"), F.coalesce(text_column, F.lit("")).alias("text"))
    side = lambda wanted: F.sort_array(F.collect_list(F.when(F.col("is_chosen") == F.lit(wanted), F.col("one"))))
    pairs = (
        turns.select(pair.alias("pair_id"), is_chosen.alias("is_chosen"), turn.alias("one"))
        .where("pair_id is not null and is_chosen is not null")
        .groupBy("pair_id")
        .agg(side(True).alias("chosen"), side(False).alias("rejected"))
    )
    same = F.zip_with("chosen", "rejected", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    pairs = pairs.withColumn("same", same).withColumn("n", F.coalesce(F.nullif(F.array_position("same", F.lit(False)), F.lit(0)) - 1, F.size("same")).cast("int"))
    after = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    pairs = pairs.select("pair_id", F.col("n").alias("n_prompt_turns"), F.slice("chosen", F.lit(1), F.col("n")).alias("common"), after("chosen").alias("chosen"), after("rejected").alias("rejected"))
    return pairs.select(
        "pair_id", "n_prompt_turns", _render(F.col("common")).alias("prompt"),
        _render(F.col("chosen")).alias("chosen"), _mask(F.col("chosen")).alias("chosen_mask"),
        _render(F.col("rejected")).alias("rejected"), _mask(F.col("rejected")).alias("rejected_mask"),
    )


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k."""
    number = F.col("conv_id")
    return format_preferences(table(spark, sf_dir, "conversations"), F.shiftright(number.cast("long"), 1), F.pmod(number, F.lit(2)) == 0)


SQL = """
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sides AS (
  SELECT pair_id, pos, max(role) FILTER (chosen) AS cr, max(text) FILTER (chosen) AS ct,
         max(role) FILTER (NOT chosen) AS rr, max(text) FILTER (NOT chosen) AS rt
  FROM turns GROUP BY pair_id, pos
), prefix AS (
  SELECT pair_id, coalesce(min(pos) FILTER (cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt) - 1, max(pos))::INTEGER AS n
  FROM sides GROUP BY pair_id
), rendered AS (
  SELECT t.*, n, pos <= n AS common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r FROM turns t JOIN prefix USING (pair_id)
), placed AS (
  SELECT *, sum(length(r)) OVER (PARTITION BY pair_id, chosen, common ORDER BY pos) - length(r) + length(role) + 5 AS s FROM rendered
)
SELECT pair_id, any_value(n) AS n_prompt_turns,
       coalesce(string_agg(r, '' ORDER BY pos) FILTER (common AND chosen), '') AS prompt,
       coalesce(string_agg(r, '' ORDER BY pos) FILTER (NOT common AND chosen), '') AS chosen,
       coalesce(string_agg(s::BIGINT || '-' || (s::BIGINT + length(text) + 7), ';' ORDER BY pos) FILTER (NOT common AND chosen AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(r, '' ORDER BY pos) FILTER (NOT common AND NOT chosen), '') AS rejected,
       coalesce(string_agg(s::BIGINT || '-' || (s::BIGINT + length(text) + 7), ';' ORDER BY pos) FILTER (NOT common AND NOT chosen AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""
