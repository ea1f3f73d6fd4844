"""Chat formatting with cumulative-snapshot collapse (operator 5); DataFrame functions only.

A log often holds a conversation several times, each time with more turns. Each turn gets a hash of all turns up to
it: the exclusive or of hashes that carry the turns' places, as a running window. A conversation whose last such
hash is that of a longer one's inner turn is a snapshot of it. Equal conversations keep the smallest id. An
anti-join keeps the maximal ones, and only these are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The rendering of a turn: role, text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, role, text`` in order of turn (nulls first), role and text; null text is empty, a null role ``unknown``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.where("conv_id is not null").withColumn("place", F.row_number().over(order))


def prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, h1, h2, length``: the hash pair of the turns up to each place."""
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    one = F.xxhash64(F.lit(1), "place", "role", "text")
    two = F.xxhash64(F.lit(2), "text", "place", "role")
    return turns(conversations).select(
        "conv_id", "place", F.bit_xor(one).over(upto).alias("h1"), F.bit_xor(two).over(upto).alias("h2"), F.max("place").over(whole).alias("length")
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no snapshot of another one."""
    marks = prefixes(conversations)
    inner = marks.where("place < length").select("h1", "h2", "place").distinct()
    last = marks.where("place = length").groupBy("h1", "h2", F.col("length").alias("place")).agg(F.min("conv_id").alias("conv_id"))
    return last.join(inner, ["h1", "h2", "place"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, chat`` of every maximal conversation.

    Rows with a null ``conv_id`` belong to no conversation and drop out; repeated rows are turns of their own; other
    columns are ignored. An empty table gives no rows.
    """
    keep = maximal(conversations)
    turn = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    parts = turns(conversations).join(keep, "conv_id").groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", turn.alias("t")))).alias("p"))
    return parts.select("conv_id", "n_turns", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("chat"))


#: The same in DuckDB: a snapshot's list of turns begins a longer list.
SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat
  FROM t GROUP BY conv_id
), p AS (
  SELECT DISTINCT md5(CAST(list_slice(l, 1, k) AS VARCHAR)) AS m, k FROM (SELECT l, unnest(range(1, n)) AS k FROM c)
), d AS (
  SELECT md5(CAST(l AS VARCHAR)) AS m, n, min(conv_id) AS conv_id FROM c GROUP BY 1, 2
)
SELECT c.conv_id, c.n AS n_turns, c.chat FROM d JOIN c ON c.conv_id = d.conv_id
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.m = d.m AND p.k = d.n)
"""
