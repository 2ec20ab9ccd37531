"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, each snapshot a prefix of the next. A rolling hash over turns
(the running sum of a hash of ordinal, role and text, in three lanes of 40 bits, so that nothing overflows
and the order of turns counts) names every turn prefix. A conversation whose whole hash is a proper prefix of
another one goes (anti-join), of conversations with equal turns the smallest conv_id stays. Only those left
are rendered, in the ChatML form ``<|im_start|>role`` line feed text ``<|im_end|>`` line feed.

All steps are DataFrame operations. Turns are gathered and put in order once, a row for each conversation
(stored); from these rows the rolling table is made once (stored, numbers only), and from the same rows those
that stay are rendered. A window with a running sum streams over a long conversation. Equal prefixes are
aggregated before they are joined, so a first turn that very many conversations share is one row.

Turns are ordered by turn, then role, then text (repeated turn numbers keep a defined order; equal rows are
turns of their own). Null role and text count as empty, null turns come first, rows with a null conv_id are
one conversation. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import stored

LANES = 3
LANE = 1 << 40
KEY = ["ordinal", *[f"h{i}" for i in range(LANES)]]


def _placed(lane: int, ordinal: Column, turn: Column) -> Column:
    """A hash of the turn's place, role and text, within a lane."""
    return F.pmod(F.xxhash64(F.lit(f"turn-{lane}"), ordinal, turn["role"], turn["text"]), F.lit(LANE))


def gathered(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, the array of (turn, role, text) in order; nulls of role and text are made empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    item = F.struct("turn", empty("role"), empty("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))


def prefixes(chats: DataFrame) -> DataFrame:
    """conv_id, ordinal, h0..h2 (rolling hashes) and last (the conversation ends here), a row for each turn."""
    each = chats.select("conv_id", F.size("turns").alias("n"), F.posexplode("turns").alias("at", "turn"))
    lanes = [_placed(i, F.col("at"), F.col("turn")).alias(f"p{i}") for i in range(LANES)]
    numbered = each.select("conv_id", (F.col("at") + 1).alias("ordinal"), (F.col("at") + 1 == F.col("n")).alias("last"), *lanes)
    running = Window.partitionBy("conv_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select("conv_id", "ordinal", "last", *[F.sum(f"p{i}").over(running).alias(f"h{i}") for i in range(LANES)])


def maximal(rolling: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that prefix no longer one; equal ones are counted."""
    whole = rolling.where("last").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = rolling.where(~F.col("last")).select(*KEY).distinct()
    return whole.join(inner, KEY, "left_anti").select("conv_id", F.col("ordinal").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: Column) -> Column:
    """The turns in ChatML form."""
    line = lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(turns, line), "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Collapse snapshots, then render what is left: conv_id, n_turns, n_copies, rendered."""
    chats = stored(gathered(conversations), "chats")
    kept = maximal(stored(prefixes(chats), "rolling"))
    same = chats["conv_id"].eqNullSafe(kept["conv_id"])
    return chats.join(kept, same).select(kept["conv_id"], "n_turns", "n_copies", rendered(F.col("turns")).alias("rendered"))


#: The same in DuckDB SQL with whole strings for hashes.
SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (
  SELECT *, row_number() OVER w AS ordinal, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (
  SELECT conv_id, ordinal, n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY ordinal) AS told
  FROM n),
whole AS (
  SELECT min(conv_id) AS conv_id, ordinal, told, count(*) AS n_copies FROM p WHERE ordinal = n_turns GROUP BY ordinal, told)
SELECT conv_id, CAST(ordinal AS BIGINT) AS n_turns, n_copies, told AS rendered
FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ordinal < p.n_turns AND p.ordinal = w.ordinal AND p.told = w.told)
"""
