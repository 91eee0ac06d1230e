"""Secret scan: base patterns, and a character network over every candidate with its context.

Base findings are the labels: candidates that a base finding covers are positive, the others
negative, and the labelled text around them teaches the network what a secret looks like. It then
adds the candidates that the patterns miss and that it scores above its threshold. Base findings stay
whatever their score.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.llm.averaging import train
from priceshape.llm.charnet import WINDOW, Net, windows
from priceshape.llm.common import col, map_rows, query, slices, table
from priceshape.scratch import pin

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of [0-9a-f]+ that are long enough
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "model")

#: What the network looks at: runs of 10 characters of keys, addresses and numbers with a digit among
#: them, and of 20 without, and whatever stands after a key's name, short or with signs.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.@=-]{8,}[A-Za-z0-9+/_=-]")
UNDIGITED = 20
VALUE = re.compile(r"""(?ai:password|passwd|pwd|passphrase|secret|token|api_?key|auth|credential)s?["']?[ \t]*[:=][ \t]*["']?([^\s"']{4,})""")
_DIGIT = re.compile("[0-9]")
_NAMES = ("password", "passwd", "secret", "token", "api")
_VALUE_NAMES = ("pass", "pwd", "secret", "token", "api", "auth", "credential")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base findings, by start, then kind."""
    found = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in order, none of which overlap; a value after a key's name goes before the runs in it."""
    runs = [m.span() for m in CANDIDATE.finditer(text) if m.end() - m.start() >= UNDIGITED or _DIGIT.search(m[0])]
    lower = text.lower()
    if not any(name in lower for name in _VALUE_NAMES):
        return runs
    values = [m.span(1) for m in VALUE.finditer(text)]
    out, i = [], 0
    for start, end in runs:
        while i < len(values) and values[i][1] <= start:
            out.append(values[i])
            i += 1
        if i == len(values) or end <= values[i][0]:
            out.append((start, end))
    return out + values[i:]


def _scanned(batches):
    """Key, base findings and candidates (span, label, windows) of each text."""
    for batch in slices(batches):
        spans, places, labels, views = [], [], [], []
        for text in batch.column("_text").to_pylist():
            text = text or ""
            base = base_findings(text)
            own = candidates(text)
            spans.append([x for b in base for x in b])
            places.append([x for c in own for x in c])
            labels.append(_labels(text, own, base))
            views.append([windows(text, *c).tobytes() for c in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(spans, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())),
             pa.array(labels, pa.list_(pa.int32())), pa.array(views, pa.list_(pa.binary()))],
            ["_id", "base", "places", "labels", "views"])


def _labels(text: str, own: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """1 for candidates that overlap a base finding, else 0; 2 for those of which nothing is known, as
    the patterns are not made for them: values after a key's name and long runs without a digit. Both
    lists are in order of their starts."""
    out, open_, i = [], [], 0
    for start, end in own:
        while i < len(base) and base[i][0] < end:
            open_.append(base[i][1])
            i += 1
        open_ = [e for e in open_ if e > start]
        plain = _DIGIT.search(text, start, end) and CANDIDATE.fullmatch(text, start, end)
        out.append(1 if open_ else 2 if not plain or VALUE.search(text, max(0, start - 40), end) else 0)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base findings and candidates of every whole text, written once; NULL and empty texts have none.
    One row per input row."""
    kind = docs.schema[key].dataType.simpleString()
    return pin(docs.select(col(key).alias("_id"), col(text).alias("_text")).mapInArrow(
        _scanned, f"_id {kind}, base array<long>, places array<long>, labels array<int>, views array<binary>"), "scan")


def fit(scanned: DataFrame) -> Net | None:
    """The network, from all labelled candidates (the first window of each); None where one of the
    kinds is missing, as in an empty table. Equal windows teach once."""
    each = scanned.where(F.size("labels") > 0).select(
        F.explode(F.arrays_zip("labels", "views")).alias("c")).select(
        F.col("c.labels").alias("y"), F.substring("c.views", 1, WINDOW).alias("x"))
    return train(pin(each.where("y < 2").distinct(), "windows"))


def find_secrets(scanned: DataFrame, net: Net | None, key: str = "doc_id") -> DataFrame:
    """Findings of each text: the key, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``findings``
    (both flat arrays of start, end and kind number; code points, end exclusive) and ``net_max``, the
    highest calibrated score of its candidates.

    One row per input row, repeated ones included. NULL and empty texts have none. The network adds
    candidates that overlap no base finding and reach its threshold; a long candidate counts by its
    highest window. Without a network the base findings are all.
    """
    kind = scanned.schema["_id"].dataType.simpleString()

    def scored(batches):
        for batch in slices(batches, 1024):
            bases, places = batch.column("base").to_pylist(), batch.column("places").to_pylist()
            labels, views = batch.column("labels").to_pylist(), batch.column("views").to_pylist()
            blobs = [np.frombuffer(v, np.uint8).reshape(-1, WINDOW) for vs in views for v in vs]
            score = np.zeros(0)
            if blobs and net is not None:
                ends = np.cumsum([len(b) for b in blobs])
                score = np.maximum.reduceat(net.probabilities(np.concatenate(blobs)), np.concatenate([[0], ends[:-1]]))
            found, highest, at = [], [], 0
            for base, place, label in zip(bases, places, labels, strict=True):
                triples = [tuple(base[i:i + 3]) for i in range(0, len(base), 3)]
                own = score[at:at + len(label)]
                at += len(label)
                triples += [(place[2 * i], place[2 * i + 1], 3) for i, p in enumerate(own) if p >= net.threshold and label[i] != 1]
                found.append([x for t in sorted(triples, key=lambda t: (t[0], t[2])) for x in t])
                highest.append(float(own.max()) if len(own) else None)
            counts = [pa.array([sum(x == k for x in b[2::3]) for b in bases], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *counts, batch.column("base"), pa.array(found, pa.list_(pa.int64())),
                 pa.array(highest, pa.float64())],
                ["_id", "n_assign", "n_access", "n_hex", "base", "findings", "net_max"])

    return scanned.mapInArrow(scored, f"_id {kind}, n_assign long, n_access long, n_hex long, "
                              "base array<long>, findings array<long>, net_max double").withColumnRenamed("_id", key)


def spans_text(findings: str):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    at = F.when(F.size(findings) > 0, F.sequence(F.lit(0), F.expr(f"CAST(size({findings}) div 3 AS INT) - 1"))) \
        .otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
    return F.array_join(F.transform(at, lambda i: F.concat_ws(
        ":", F.get(names, F.get(findings, i * 3 + 2).cast("int")), F.get(findings, i * 3).cast("string"),
        F.get(findings, i * 3 + 1).cast("string"))), ",")


def redact(docs: DataFrame, net: Net | None, mark: str = "<SECRET>", text: str = "text",
           length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every finding replaced by ``mark``; overlapping findings become one.
    ``length``, where there is such a column, follows the text. NULL texts stay NULL."""
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None

    def findings(texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of every text; the network sees all candidates of the batch at once."""
        bases = [base_findings(t) for t in texts]
        spans = [[b[:2] for b in base] for base in bases]
        if net is None:
            return spans
        new = [(i, c) for i, (t, base) in enumerate(zip(texts, bases, strict=True))
               for own in [candidates(t)] for c, label in zip(own, _labels(t, own, base), strict=True) if label != 1]
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            views = [windows(texts[i], *c) for i, c in part]
            ends = np.cumsum([len(v) for v in views])
            best = np.maximum.reduceat(net.probabilities(np.concatenate(views)), np.concatenate([[0], ends[:-1]]))
            for (i, c), p in zip(part, best, strict=True):
                if p >= net.threshold:
                    spans[i].append(c)
        return spans

    def cleaned(value: str | None, spans: list[tuple[int, int]]) -> str | None:
        if not value:
            return value
        out, done = [], 0
        for start, end in sorted(spans):
            if start >= done:
                out += [value[done:start], mark]
            done = max(done, end)
        return "".join(out) + value[done:] if spans else value

    def changed(batches):
        for batch in slices(batches):
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            texts = [cleaned(t, f) for t, f in zip(old, findings([t or "" for t in old]), strict=True)]
            if size is not None:
                columns[size] = pa.array([n if t == o else len(t) for n, t, o in zip(columns[size].to_pylist(), texts, old, strict=True)],
                                         columns[size].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_rows(docs, changed)


@query("op6_secret_network")
def op6(spark, sf_dir):
    """Findings of every document."""
    scanned = scan(table(spark, sf_dir, "documents"))
    return find_secrets(scanned, fit(scanned)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"), spans_text("findings").alias("spans"))
