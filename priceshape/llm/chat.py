"""Preference pairs as one prompt and two masked completions, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceshape.llm.common import col, query, table

#: Marks around the role and the text of a turn.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, an array of role and text in turn order.

    Turns of equal number follow each other by role, then text. NULL roles and texts count as empty.
    Rows without a conversation id belong to none and are left out. A conversation is one record
    here as its rendering is one text.
    """
    ordered = F.array_sort(F.collect_list(F.struct(
        col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"))))
    return turns.where(col(conv_id).isNotNull()).groupBy(col(conv_id).alias("conv_id")).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        .alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE)))


def _mask(turns: Column, trained: str) -> Column:
    """Spans (code points, end exclusive) of the rendered turns that the loss counts: text and
    closing mark of the turns of the trained role."""
    head = len(OPEN) + len(AFTER_ROLE)

    def step(state, t):
        start = state["at"] + head + F.length(t["role"])
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(
            end.cast("int").alias("at"),
            F.when(t["role"] == trained, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"]).alias("spans"))

    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step,
                       lambda state: state["spans"])


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """Render preference pairs.

    ``pairs`` has ``pair_id``, ``chosen`` and ``rejected`` (arrays of role and text). The longest
    common prefix of turns is rendered once as ``prompt`` (its turns in ``prompt_turns``); what
    follows on either side is a completion with the spans that count for the loss: text and closing
    mark of the trained role's turns. NULL conversations, roles and texts count as empty. Conversations that are
    equal, or of which one is a prefix of the other, give an empty completion without spans. Repeated
    pairs give repeated rows; other columns are left out. Work and memory are per pair.
    """
    def side(name: str) -> Column:
        turns = F.coalesce(col(name), F.expr("CAST(array() AS ARRAY<STRUCT<role: STRING, text: STRING>>)"))
        return F.transform(turns, lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    both = pairs.select("pair_id", side("chosen").alias("chosen"), side("rejected").alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.array_position(
        F.zip_with(F.slice("chosen", 1, F.greatest(shorter, F.lit(0))),
                   F.slice("rejected", 1, F.greatest(shorter, F.lit(0))),
                   lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])), F.lit(False))
    cut = both.withColumn("prompt_turns", F.when(differs > 0, differs.cast("int") - 1)
                          .otherwise(shorter))
    rest = {c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
            for c in ("chosen", "rejected")}
    return cut.select(
        "pair_id", "prompt_turns",
        F.array_join(_rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns"))), "").alias("prompt"),
        F.array_join(_rendered(rest["chosen"]), "").alias("chosen"),
        F.array_join(_rendered(rest["rejected"]), "").alias("rejected"),
        _mask(rest["chosen"], trained).alias("chosen_mask"),
        _mask(rest["rejected"], trained).alias("rejected_mask"))


def neighbour_pairs(convs: DataFrame) -> DataFrame:
    """Conversations 2 k (chosen) and 2 k + 1 (rejected) as pair k; a missing one is NULL."""
    side = F.pmod("conv_id", F.lit(2))
    pair = F.floor((F.col("conv_id") - side) / 2).cast("long")
    return convs.groupBy(pair.alias("pair_id")).agg(
        F.max(F.when(side == 0, F.col("turns"))).alias("chosen"),
        F.max(F.when(side == 1, F.col("turns"))).alias("rejected"))


_OP3_SQL = f"""
WITH turn AS (
  SELECT conv_id, CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 <> 0 AS other,
         coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (
  SELECT pair_id, count(*) FILTER (NOT other) AS a, count(*) FILTER (other) AS b FROM turn GROUP BY 1),
same AS (
  SELECT c.pair_id, c.i, c.role = r.role AND c.text = r.text AS equal
  FROM turn c JOIN turn r ON r.pair_id = c.pair_id AND r.i = c.i AND r.other AND NOT c.other),
cut AS (
  SELECT pair_id, CAST(least(a, b, coalesce(first_other, 9223372036854775807) - 1) AS INTEGER) AS prompt_turns
  FROM size LEFT JOIN (SELECT pair_id, min(i) AS first_other FROM same WHERE NOT equal GROUP BY 1)
    USING (pair_id)),
line AS (
  SELECT turn.*, prompt_turns, '{OPEN}' || role || chr(10) || text || '{CLOSE[:-1]}' || chr(10) AS line
  FROM turn JOIN cut USING (pair_id)),
place AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
         length(role) + {len(OPEN) + len(AFTER_ROLE)} AS head
  FROM line WHERE i > prompt_turns),
span AS (
  SELECT pair_id, other, i, line,
         CASE WHEN role = 'assistant' THEN (upto - length(line) + head) || ':' || upto END AS span
  FROM place)
SELECT pair_id, prompt_turns,
  coalesce((SELECT string_agg(line, '' ORDER BY i) FROM line l
            WHERE l.pair_id = cut.pair_id AND NOT other AND i <= l.prompt_turns), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (NOT other), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (other), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (NOT other), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (other), '') AS rejected_mask
FROM cut LEFT JOIN span USING (pair_id)
GROUP BY pair_id, prompt_turns"""


@query("op3_preference_format", _OP3_SQL)
def op3(spark, sf_dir):
    """Neighbouring conversations as preference pairs; spans as text."""
    pairs = neighbour_pairs(conversations(table(spark, sf_dir, "conversations")))

    def text(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")

    return format_preferences(pairs).withColumns(
        {m: text(m) for m in ("chosen_mask", "rejected_mask")})
