"""Byte-level BPE by tree concatenation.

A text longer than ``leaf_chars`` is halved until its parts are short enough; the parts are encoded
in parallel tasks, and neighbours are put together by encoding a window around the join anew. A window
of text ends where pieces of the split pattern end whatever stands around them, and grows until there
are such places on both sides. A piece that the pattern leaves whole across the join, however long, is
joined on tokens: a sequence of BPE tokens is the encoding of its text if each pair of neighbours is,
so a window of tokens whose encoding begins and ends with the old outer tokens settles the join, and
it grows until it does. What lies outside the windows is never encoded again.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceshape.llm.common import col, query, slices, table
from priceshape.llm.tokenizing import load, once

#: Characters of a part that one task encodes by itself, and of a window of text; a longer one is
#: joined by its pieces.
LEAF_CHARS, WINDOW = 16_384, 4_096

#: Letters that every version of the character tables has; all white space and ASCII digits are that.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
#: Signs that every version has as neither letter nor digit.
SIGNS = "!-/:-@\\[-`{-~、-〃〈-】！-／："
#: Places where a piece ends and another begins: before white space after anything else, and where a
#: run of letters or digits ends. No piece of the split pattern goes on there.
_SAFE = regex.compile(
    rf"(?<=\P{{White_Space}})(?=\p{{White_Space}})|(?<=[{LETTERS}])(?=[0-9{SIGNS}])|(?<=[0-9])(?=[{LETTERS}{SIGNS}])")

#: Texts that are one piece.
_ONE = regex.compile(rf" ?(?:[{LETTERS}]+|[0-9]+|[{SIGNS}]+)|\p{{White_Space}}+")


def _names(path: str) -> tuple[list[str], dict[str, int]]:
    """Names of all ids of a vocabulary file, and its added tokens."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    added = {t["content"]: t["id"] for t in made["added_tokens"]}
    ids = {**made["model"]["vocab"], **added}
    names = [""] * (max(ids.values()) + 1)
    for name, i in ids.items():
        names[i] = name
    return names, added


@functools.lru_cache
def is_byte_level(path: str) -> bool:
    """Whether the merges of a vocabulary file can run by the ids of the bytes they form."""
    names, added = _names(path)
    tokenizer, plain = load(path), [i for i, name in enumerate(names) if name not in added]
    split = str(tokenizer.pre_tokenizer)
    return (tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in split and "use_regex=True" in split
            and plain[:256] == list(range(256)) and all(len(x) == 1 for x in _bytes_of(names[:256]))
            and all([t.id for t in tokenizer.model.tokenize(names[i])] == [i] for i in plain))


class TreeEncoder:
    """Encoder of texts and joins for a byte-level vocabulary in the tokenizers library's format.

    The merges run in tiktoken, which merges any two neighbours whose bytes form a token, the lowest id
    first. That is the library's result if merges are listed by id and every token is the encoding of
    its own bytes: the first merge that the library does not list would form a token out of two parts
    at which the library, encoding that token alone, would have stopped. Both are checked, once on the
    driver (``proven``); other vocabularies go through the library itself.
    """

    def __init__(self, path: str, proven: bool | None = None):
        self.path, self._tokenizer = path, None
        self.name, self.added = _names(path)
        self.by_added = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.margin = max(map(len, self.added), default=1)
        self.bytes = _bytes_of(self.name)
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.coder = None
        if is_byte_level(path) if proven is None else proven:
            self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
                x: i for i, x in enumerate(self.bytes) if self.name[i] not in self.added})

    @property
    def tokenizer(self):
        """The library's tokenizer, which most workers never need."""
        if self._tokenizer is None:
            self._tokenizer = load(self.path)
        return self._tokenizer

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; none for NULL."""
        if not text:
            return b""
        if self.coder is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.by_added is None or not self.by_added.search(text):
            return self._plain(text)
        return b"".join([np.array([self.added[x]], "<u4").tobytes() if x in self.added else self._plain(x)
                         for x in self.by_added.split(text) if x])

    def _plain(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def merge(self, name: str) -> list[int]:
        """Ids of a piece in the alphabet of the vocabulary, without any split."""
        return [t.id for t in self.tokenizer.model.tokenize(name)]

    def pieces(self, text: str) -> list[str]:
        if _ONE.fullmatch(text):
            return [text]
        return [text[start:end] for _, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of one piece from those of its two parts."""
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            new = self.merge("".join([self.name[i] for i in (*a.tolist(), *b.tolist())]))
            if ((width >= len(left) or new[0] == a[0])
                    and (width >= len(right) or new[-1] == b[-1])):
                return np.concatenate([left[:max(0, len(left) - width)], np.array(new, "<u4"), right[width:]])
            width *= 2

    def _place(self, text: str, at: int, back: bool) -> int:
        """The next safe place before (or after) ``at``, no part of an added token; else an end of the text."""
        step = 64
        while 0 < at < len(text):
            low, high = (max(0, at - step), at) if back else (at, min(len(text), at + step))
            found = [m.start() for m in _SAFE.finditer(text, low, min(len(text), high + 1)) if low <= m.start() <= high]
            for place in reversed(found) if back else found:
                around = max(0, place - self.margin)
                cut = self.by_added and any(around + m.start() < place < around + m.end() for m in self.by_added.finditer(
                    text[around:place + self.margin], overlapped=True))
                if 0 < place < len(text) and not cut:
                    return place
            at, step = (low, step * 2) if back else (high, step * 2)
        return 0 if back else len(text)

    def _tail(self, ids: np.ndarray, size: int) -> int:
        """Number of tokens at the end that make up ``size`` bytes."""
        return int(np.searchsorted(np.cumsum(self.length[ids[::-1]]), size)) + 1 if size else 0

    def join_texts(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
        """Two neighbouring parts and their ids to those of the whole."""
        (a, a_ids), (b, b_ids) = left, right
        if not a or not b:
            return a + b, a_ids + b_ids
        i = self._place(a, max(0, len(a) - self.margin), True)
        k = self._place(b, min(len(b), self.margin), False)
        middle = a[i:] + b[:k]
        if len(middle) > WINDOW and not (self.by_added and self.by_added.search(middle)):
            joined = self._join_pieces(a[i:], b[:k], np.frombuffer(a_ids, "<u4"), np.frombuffer(b_ids, "<u4"))
            if joined is not None:
                return a + b, joined
        old_a, old_b = self.encode(a[i:]), self.encode(b[:k])
        return a + b, a_ids[:len(a_ids) - len(old_a)] + self.encode(middle) + b_ids[len(old_b):]

    def _join_pieces(self, tail: str, head: str, a_ids: np.ndarray, b_ids: np.ndarray) -> bytes | None:
        """Join where no safe place is near: the pieces of both sides that stay are left alone, and one
        piece across the join is joined on tokens. None if the pieces change otherwise."""
        a, b, whole = self.pieces(tail), self.pieces(head), self.pieces(tail + head)
        same = 0
        while same < min(len(a), len(whole)) and a[same] == whole[same]:
            same += 1
        a, whole, same = a[same:], whole[same:], 0
        while same < min(len(b), len(whole)) and b[-1 - same] == whole[-1 - same]:
            same += 1
        b, whole = b[:len(b) - same], whole[:len(whole) - same]
        if not a and not whole and not b:
            return a_ids.tobytes() + b_ids.tobytes()
        if not (len(a) == len(b) == len(whole) == 1 and a[0] + b[0] == whole[0]):
            return None
        left = self._tail(a_ids, len(a[0].encode()))
        right = int(np.searchsorted(np.cumsum(self.length[b_ids]), len(b[0].encode()))) + 1
        made = self.join(a_ids[len(a_ids) - left:], b_ids[:right])
        return np.concatenate([a_ids[:len(a_ids) - left], made, b_ids[right:]]).astype("<u4").tobytes()


def cut(text: str, leaf_chars: int) -> list[str]:
    """The leaves of the halving."""
    if len(text) <= leaf_chars:
        return [text]
    half = len(text) // 2
    return cut(text[:half], leaf_chars) + cut(text[half:], leaf_chars)


def concatenate(encoder: TreeEncoder, leaves: list[tuple[str, bytes]]) -> bytes:
    """Ids of the whole from leaves in order, joined pairwise as they were cut."""
    while len(leaves) > 1:
        leaves = [encoder.join_texts(*leaves[i:i + 2]) if i + 1 < len(leaves) else leaves[i]
                  for i in range(0, len(leaves), 2)]
    return leaves[0][1]


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Key and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text.

    The ids are those of the tokenizers library without special tokens added; the string of an added
    token inside a text becomes that token, as there. NULL and empty texts have no ids. One row per
    input row, repeated rows included; other columns are left out. A document is put together in one
    task, so memory is bounded by the longest document.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(col(key).alias("_id"), F.coalesce(col(text), F.lit("")).alias("_text"))
    is_long = F.length("_text") > leaf_chars
    proven = is_byte_level(path)

    def short(batches):
        encoder = once(TreeEncoder, path, proven)
        for batch in slices(batches):
            ids = [encoder.encode(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.binary())], ["_id", "ids"])

    def halves(batches):
        for batch in slices(batches, 16):
            for i, t in enumerate(batch.column("_text").to_pylist()):
                parts = cut(t, leaf_chars)
                at = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").take(at), batch.column("_id").take(at),
                     pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                    ["_row", "_id", "leaf", "part"])

    def leaf(batches):
        encoder = once(TreeEncoder, path, proven)
        for batch in slices(batches, 64):
            ids = [encoder.encode(t) for t in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary())], ["_row", "_id", "leaf", "part", "ids"])

    def whole(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        parts = list(zip(group.column("part").to_pylist(), group.column("ids").to_pylist(), strict=True))
        encoder = once(TreeEncoder, path, proven)
        ids = concatenate(encoder, parts)
        return pa.table({"_id": group.column("_id").slice(0, 1), "ids": pa.array([ids], pa.binary())})

    # The leaves of a text come out of one row of one task, so their number for the row is one.
    leaves = rows.where(is_long).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        halves, f"_row long, _id {kind}, leaf int, part string").repartition("_row", "leaf").mapInArrow(
        leaf, f"_row long, _id {kind}, leaf int, part string, ids binary")
    made = leaves.groupBy("_row").applyInArrow(whole, f"_id {kind}, ids binary").union(
        rows.where(~is_long).mapInArrow(short, f"_id {kind}, ids binary"))
    return made.withColumnRenamed("_id", key)


def _bytes_of(names: list[str]) -> list[bytes]:
    """Bytes of each id: the vocabulary writes them in a printable alphabet, in which the printable
    bytes stand for themselves and the others, in order, for the characters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return [bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
            for name in names]


def _decoder(path: str) -> list[bytes]:
    """Workers that only decode keep the bytes alone."""
    return _bytes_of(_names(path)[0])


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; special tokens are kept as their strings.

    Other columns stay as they are; one of the name ``decoded`` is replaced. NULL ids decode to NULL.
    """
    encoded = encoded.drop("decoded")
    at, names = encoded.columns.index(ids), encoded.columns
    plain = encoded.toDF(*[f"c{i}" for i in range(len(names))])

    def decoded(batches):
        known = once(_decoder, path)
        for batch in slices(batches):
            texts = [None if x is None else
                     b"".join(map(known.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace")
                     for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, "decoded"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields]
    return plain.mapInArrow(decoded, ", ".join([*kinds, "decoded string"])).toDF(*names, "decoded")


def digest(docs: DataFrame, path: str) -> DataFrame:
    return decode_documents(encode_documents(docs, path), path).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op8_bpe_tree")
def op8(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
