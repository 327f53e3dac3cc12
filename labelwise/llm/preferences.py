"""Preference formatting of chosen and rejected conversations, with DataFrame operations only.

A pair has two sides, each a conversation of turns. Its longest common turn prefix -- all turns before the first turn
number at which the sides differ -- is rendered once as the prompt; the rest of each side is its completion. The result
has a row for every rendered turn, so a conversation of any length is never gathered in one task:
``pair_id, part`` (prompt, chosen, rejected)``, turn, role, rendered, train``. ``train`` masks the loss: true for
assistant turns of completions only. Concatenating ``rendered`` by turn gives the prompt and the two completions.

Nulls: rows without a pair or side are left out; a null turn is turn -1, a null role or text is empty. Repeated rows of
a turn are kept; sides are equal at a turn if they have the same rows there. A side without rows is an empty
conversation. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the rendering of a turn
BEGIN, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def preference_turns(conversations: DataFrame, pair: Column, rejected: Column) -> DataFrame:
    """``conversations`` (``turn, role, text``) with the pair of each row and whether it is the rejected side."""
    t = (conversations.select(pair.cast("long").alias("pair_id"), rejected.cast("boolean").alias("side"),
                              F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
                              F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
         .where("pair_id is not null and side is not null"))
    row = F.struct("role", "text")
    digest = F.xxhash64("role", "text").cast("decimal(38,0)")

    def both(f) -> Column:
        """An aggregate of the chosen and of the rejected rows, compared."""
        return f(F.when(~F.col("side"), row), F.when(~F.col("side"), digest)).eqNullSafe(
            f(F.when(F.col("side"), row), F.when(F.col("side"), digest)))

    # one row on each side is compared as it is, several by their number, extremes and sum of digests
    same = (both(lambda r, d: F.count(r)) & both(lambda r, d: F.min(r)) & both(lambda r, d: F.max(r)) & both(lambda r, d: F.sum(d)))
    split = (t.groupBy("pair_id", "turn").agg(same.alias("same")).where(~F.col("same"))
             .groupBy("pair_id").agg(F.min("turn").alias("split")))
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    return (t.join(split, "pair_id", "left").where(~(common & F.col("side")))
            .select("pair_id", F.when(common, "prompt").when(F.col("side"), "rejected").otherwise("chosen").alias("part"),
                    "turn", "role",
                    F.concat(F.lit(BEGIN), "role", F.lit(AFTER_ROLE), "text", F.lit(END)).alias("rendered"),
                    (~common & (F.col("role") == "assistant")).alias("train")))
