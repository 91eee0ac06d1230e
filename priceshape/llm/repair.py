"""Structural repair of conversations: faults, cheapest edits, repaired turns.

Texts are shuffled once. The plan of a conversation needs a byte per row, not its texts: rows are
reduced to id, turn, role, a digest of the text and two flags, equal ones are counted before the
shuffle, and a sorted stream of the counts gives every conversation its plan (``auction.py``). The
plans then head the sorted stream of the whole rows, which are repaired, or hashed, as they pass. A
task holds the bytes of one conversation and one batch of rows, however long the conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceshape.llm import auction
from priceshape.llm.common import col, query, slices, table

_BLANK = r"NOT _text RLIKE '[^\\x20\\x09-\\x0D]'"
_WHOLE = r"_text RLIKE '[.!?][\\x20\\x09-\\x0D]*+\\z'"
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _or_space(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(" "))


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``turns`` with seeded faults, decided per row by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 doubles the row, 4 makes
    the role ``user``. NULL ids and turns count as one space in the key, NULL roles and texts become
    one space. All columns are kept; rows with the same id and turn fare alike. An empty table stays
    empty.
    """
    names = turns.columns
    plain = turns.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {name: f"_c{names.index(name)}" for name in (conv_id, turn, role, text)}
    kind = F.pmod(F.crc32(F.concat(_or_space(at[conv_id]), F.lit(":"), _or_space(at[turn])).cast("binary")), F.lit(20))
    rows = plain.withColumn("_kind", kind).where("_kind <> 0").withColumn(
        "_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    words = _or_space(at[text])
    new = {
        at[role]: F.when(F.col("_kind") == 4, F.lit("user")).otherwise(_or_space(at[role])),
        at[text]: F.when(F.col("_kind") == 1, F.lit("")).when(
            F.col("_kind") == 2, F.translate(words, ".!?", "")).otherwise(words),
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*names)


def _rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Id, turn, role and text under fixed names, with the digest of the text that orders equal turns."""
    return turns.select(col(conv_id).alias("_id"), col(turn).cast("long").alias("_turn"),
                        _or_space(role).alias("_role"), _or_space(text).alias("_text")).withColumn(
        "_digest", F.unhex(F.sha2("_text", 256)))


_ORDER = ("_turn", "_role", "_digest")


def _codes(rows: DataFrame) -> DataFrame:
    """Counted rows with the byte of their first copy; later copies are duplicates unless blank."""
    counted = rows.select("_id", "_turn", "_role", "_digest", F.expr(_BLANK).alias("_blank"), F.expr(_WHOLE).alias("_whole")).groupBy(
        "_id", "_turn", "_role", "_digest", "_blank", "_whole").count()
    seen = Window.partitionBy("_id", "_role", "_digest").orderBy(F.asc_nulls_first("_turn"))
    fault = (F.when(F.col("_blank"), auction.BLANK).when(F.row_number().over(seen) > 1, auction.DUPLICATE)
             .when(~F.col("_whole"), auction.CUT).otherwise(auction.NONE))
    initial = F.expr(f"CASE WHEN _role = '' THEN 0 ELSE greatest(instr('{auction.INITIALS}', substr(_role, 1, 1)) - 1, 0) END")
    return counted.select("_id", "_turn", "_role", "_digest", F.col("count").alias("_n"),
                          (initial + 4 * fault).cast("int").alias("_code"))


class _Conversation:
    """Counts of one conversation, as its sorted rows pass."""

    def __init__(self) -> None:
        self.codes, self.turns = bytearray(), 0
        self.first = self.last = None

    def add(self, turn: int | None, code: int, n: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.turns == 0 else self.first
            self.last, self.turns = turn, self.turns + 1
        self.codes.append(code)
        if n > 1:
            again = code if code // 4 == auction.BLANK else code % 4 + 4 * auction.DUPLICATE
            self.codes.extend(bytes([again]) * (n - 1))

    def counts(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        pairs = codes[:-1] % 4 * 4 + codes[1:] % 4
        legal = [4 * auction.INITIALS.index(x[0]) + auction.INITIALS.index(x[1]) for x in ("su", "ua", "au")]
        faults = np.bincount(codes // 4, minlength=4)
        cost, audit = auction.plan(bytes(self.codes))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *[int(n) for n in faults[1:4]], int(np.sum(~np.isin(pairs, legal))), cost, audit)


def plans(turns: DataFrame, every: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn",
          role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost`` and ``audit``.

    Rows stand by turn (NULL first), those of equal turn by role and SHA-256 of the text. Each row
    counts for its first fault. ``gaps`` ignores NULL turns. ``audit`` has a letter per edit: Keep,
    Rerole, Delete, Insert; of equally cheap plans the least string. A row can be kept only if its role
    begins with s, u or a where that may stand. NULL roles and texts count as one space; rows with a
    NULL id are one conversation. ``every`` (its first column) may name conversations without rows,
    which have zeros and an empty audit. A table without rows gives none but those.
    """
    return _plans(_rows(turns, conv_id, turn, role, text), every).withColumnRenamed("_id", conv_id)


def _plans(rows: DataFrame, every: DataFrame | None) -> DataFrame:
    codes = _codes(rows)
    kind = rows.schema["_id"].dataType
    if every is not None:
        ids = every.select(col(every.columns[0]).cast(kind).alias("_id")).distinct()
        codes = codes.unionByName(ids.withColumn("_n", F.lit(0).cast("long")), allowMissingColumns=True)

    def made(batches):
        now, held, ids, out = None, None, [], []

        def batch():
            columns = list(zip(*out, strict=True))
            types = [pa.int64()] * 6 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for piece in slices(batches, 8192):
            names = piece.column("_id").to_pylist()
            for i, (name, turn_, code, n) in enumerate(zip(
                    names, *[piece.column(c).to_pylist() for c in ("_turn", "_code", "_n")], strict=True)):
                if held is None or name != now:
                    if held is not None:
                        out.append(held.counts())
                    now, held = name, _Conversation()
                    ids.append(piece.column("_id").slice(i, 1))
                if n:
                    held.add(turn_, code, n)
            if len(out) >= 4096:
                last = ids.pop()
                yield batch()
                ids, out = [last], []
        if held is not None:
            out.append(held.counts())
            yield batch()

    return codes.repartition("_id").sortWithinPartitions("_id", *_ORDER).select("_id", "_turn", "_code", "_n").mapInArrow(
        made, f"_id {kind.simpleString()}, {_COUNTS}")


def _headed(turns: DataFrame, every: DataFrame | None, names: tuple[str, str, str, str]) -> tuple[DataFrame, str]:
    """The rows of every conversation in order, its plan before them."""
    rows = _rows(turns, *names)
    both = rows.unionByName(_plans(rows, every), allowMissingColumns=True)
    ordered = both.repartition("_id").sortWithinPartitions("_id", F.col("audit").isNull(), *_ORDER)
    return ordered.select("_id", "_role", "_text", *[c.split()[0] for c in _COUNTS.split(", ")]), \
        rows.schema["_id"].dataType.simpleString()


def _edited(audit: str):
    """Per row of a conversation the repaired turns up to and with it; a last item after all rows."""
    roles, at = auction.Roles(), 0

    def upto(role: str | None, text: str | None) -> list[tuple[str, str]]:
        nonlocal at
        out = []
        while at < len(audit):
            label = audit[at]
            if label != "I" and role is None:
                raise RuntimeError("fewer rows than planned")
            at += 1
            if label == "D":
                return out
            new = roles.next(label, (role or "")[:1])
            out.append((new or role, "" if label == "I" else text))
            if label != "I":
                return out
        return out

    return upto


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """The repaired turns: conversation id, ``position`` (long, from 0), role and text.

    NULLs, ties and empty tables as in ``plans``; other columns are left out. A conversation of which
    nothing can stay has no rows.
    """
    ordered, kind = _headed(turns, None, (conv_id, turn, role, text))

    def made(batches):
        edit, ident, place = None, None, 0
        for batch in slices(batches, 1024):
            ids, out = [], []

            def put(items, ids=ids, out=out):
                nonlocal place
                for r, t in items:
                    ids.append(ident)
                    out.append((place, r, t))
                    place += 1

            for i, (a, r, t) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("audit", "_role", "_text")], strict=True)):
                if a is not None:
                    if edit is not None:
                        put(edit(None, None))
                    edit, ident, place = _edited(a), batch.column("_id").slice(i, 1), 0
                else:
                    put(edit(r, t))
            if out:
                yield _turns(ids, out)
        if edit is not None:
            ids, out = [], []
            put(edit(None, None), ids, out)
            if out:
                yield _turns(ids, out)

    def _turns(ids, out):
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]],
            ["_id", "position", "role", "text"])

    return ordered.mapInArrow(made, f"_id {kind}, position long, role string, text string").toDF(
        conv_id, "position", role, text)


def repair_digests(turns: DataFrame, every: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """``plans`` with ``repaired_sha256``: of the repaired ``role:text``, joined by newlines (UTF-8).

    One row per conversation, also of ``every``; one without repaired turns has the hash of nothing.
    """
    ordered, kind = _headed(turns, every, (conv_id, turn, role, text))
    names = [c.split()[0] for c in _COUNTS.split(", ")]

    def made(batches):
        edit, held, digest, first = None, None, None, True
        done: list[pa.RecordBatch] = []

        def put(items):
            nonlocal first
            for r, t in items:
                digest.update(("" if first else "\n").encode() + f"{r}:{t}".encode("utf-8", "surrogatepass"))
                first = False

        def close():
            put(edit(None, None))
            done.append(held.append_column("repaired_sha256", pa.array([digest.hexdigest()])))

        for batch in slices(batches, 1024):
            plan = batch.select(["_id", *names])
            for i, (a, r, t) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("audit", "_role", "_text")], strict=True)):
                if a is None:
                    put(edit(r, t))
                    continue
                if edit is not None:
                    close()
                edit, held, digest, first = _edited(a), plan.slice(i, 1), hashlib.sha256(), True
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done.clear()
        if edit is not None:
            close()
            yield from done

    return ordered.mapInArrow(made, f"_id {kind}, {_COUNTS}, repaired_sha256 string").withColumnRenamed("_id", conv_id)


def _add(state: str, cost: str, label: str) -> str:
    """A state of the SQL form, ten digits of cost and the labels so far, with one edit more."""
    return f"lpad((substr({state}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || '{label}'"


_MAY = "fault IN (0, 3)"
_KEEP, _REROLE = "5 * (fault = 3)::INT", "1 + 5 * (fault = 3)::INT"


def _from(states: str, initial: str) -> str:
    kept = [f"CASE WHEN {_MAY} AND ini = '{initial}' THEN {_add(s, _KEEP, 'K')} END" for s in states.split()]
    return ", ".join(kept + [f"CASE WHEN {_MAY} THEN {_add(s, _REROLE, 'R')} END" for s in states.split()])


SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(k, ''),
           lambda c: list_transform(range(8), lambda b: ((ascii(c) >> b::INT) & 1)::UBIGINT)))),
           lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (xor(a, b) & 1))), 4294967295::UBIGINT) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copies,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, substr(role, 1, 1) AS ini FROM placed
), rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN copies > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows GROUP BY conv_id
), steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '0000000000' AS s0, NULL::VARCHAR AS s1,
         '0000000005I' AS s2, '0000000010II' AS s3 FROM rows
  UNION ALL
  SELECT conv_id, i, m0, m1, t2, least(m3, {_add("t2", "5", "I")})
  FROM (SELECT *, least(m2, {_add("m0", "5", "I")}, {_add("m1", "5", "I")}, {_add("m3", "5", "I")}) AS t2
  FROM (SELECT r.conv_id, r.i, {_add("s0", "2", "D")} AS m0,
          least({_add("s1", "2", "D")}, CASE WHEN {_MAY} AND ini = 's' THEN {_add("s0", _KEEP, "K")} END) AS m1,
          least({_add("s2", "2", "D")}, {_from("s0 s1 s3", "u")}) AS m2,
          least({_add("s3", "2", "D")}, {_from("s2", "a")}) AS m3
        FROM steps s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1))
), best AS (
  SELECT c.*, least(s0, s3) AS found FROM steps s JOIN counts c
  ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i
), items AS (
  SELECT conv_id, unnest(range(1, length(found) - 9)) AS p, substr(found, 11) AS audit FROM best
), labels AS (
  SELECT *, substr(audit, p::INT, 1) AS label, count(*) FILTER (substr(audit, p::INT, 1) <> 'I') OVER w AS row_no,
         count(*) FILTER (substr(audit, p::INT, 1) <> 'D') OVER w AS turn_no
  FROM items WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), made AS (
  SELECT l.*, r.role, r.text, max((label = 'K' AND turn_no = 1 AND ini = 's')::INT) OVER (PARTITION BY l.conv_id) AS led
  FROM labels l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.row_no AND l.label <> 'I'
), joined AS (
  SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (turn_no - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole FROM made WHERE label <> 'D' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(substr(found, 1, 10)::BIGINT, 0) AS cost, coalesce(substr(found, 11), '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_conversation_repair", SQL)
def op12(spark, sf_dir):
    """Faults, cheapest edits and digest of the repaired turns of every damaged conversation."""
    turns = table(spark, sf_dir, "conversations")
    return repair_digests(damage(turns), turns.select("conv_id"))
