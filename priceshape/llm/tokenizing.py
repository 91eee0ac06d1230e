"""Exact encoding of long texts by independent segments, each encoded once per worker.

White space that follows other characters always begins a new piece of the tokenizers' split
patterns, and no piece spans it, so the parse of what follows depends on nothing before it. A text is
cut there, and the ids of a cut-out segment are remembered. U+001C to U+001F are white space to
Python but not to the patterns; texts with them are one segment.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

import numpy as np
import tiktoken

#: Segments and stems that a worker remembers; then it starts anew.
WORDS, STEMS = 400_000, 800_000
#: Characters of a segment that go to the library whole.
SHORT = 1024
#: Characters after which the texts met so far are encoded.
CHARS = 1 << 20

#: Few ids as little-endian unsigned 32-bit integers.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]

_APART = re.compile("[\x1c-\x1f]")
_RUN = re.compile(r"\s ")
_SEGMENT = re.compile(r"\s*\S+|\s+")


def load(path: str):
    """The tokenizer of a file, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Segments:
    """Encodes texts to little-endian unsigned 32-bit ids, segment by segment."""

    def __init__(self, path: str, keep_space: bool):
        self.tokenizer = load(path)
        self.keep_space = keep_space
        self.seen: dict[str, bytes] = {}
        self.long = self._whole
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark_id = max(added, default=None)
        self.mark = added[self.mark_id].content if added else None

    def _whole(self, segment: str) -> bytes:
        return np.array(self.tokenizer.encode(segment, add_special_tokens=False).ids, "<u4").tobytes()

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if _APART.search(text):
            return [text]
        if not self.keep_space:  # the pattern drops white space
            return text.split()
        if _RUN.search(text):
            return _SEGMENT.findall(text)
        first, *others = text.split(" ")
        return ([first] if first else []) + [" " + x for x in others]

    def _learn(self, segments: list[str]) -> None:
        """Encode new segments in one call: an added token between them keeps them apart, as the
        library cuts a text at added tokens before anything else."""
        apart = [x for x in segments if self.mark is None or self.mark in x]
        for x in apart:
            self.seen[x] = self._whole(x)
        joined = [x for x in segments if x not in self.seen] if apart else segments
        if not joined:
            return
        found = self.tokenizer.encode_batch_fast([self.mark.join(joined)], add_special_tokens=False)
        ids = np.array(found[0].ids, "<u4")
        ends = (np.flatnonzero(ids == self.mark_id) * 4).tolist() + [4 * len(ids)]
        data, start = ids.tobytes(), 0
        for x, end in zip(joined, ends, strict=True):
            self.seen[x] = data[start:end]
            start = end + 4

    def encode(self, text: str | None) -> bytes:
        parts = self.segments(text or "")
        new = [x for x in dict.fromkeys(parts) if x not in self.seen]
        if len(new) + len(self.seen) > REMEMBERED:
            self.seen.clear()
            new = list(dict.fromkeys(parts))
        small = [x for x in new if len(x) <= SHORT]
        self._learn(small)
        large = {x: self.long(x) for x in new if len(x) > SHORT}
        if large:
            return b"".join([large[x] if x in large else self.seen[x] for x in parts])
        return b"".join(map(self.seen.__getitem__, parts))


_made: dict[tuple, object] = {}


def once(make, *args):
    """``make(*args)``, made once per worker."""
    key = (make, *args)
    if key not in _made:
        _made[key] = make(*args)
    return _made[key]


#: Ends a word in the merges; no byte of UTF-8 text.
END = b"\xff"


def printable_bytes() -> dict[str, int]:
    """The alphabet that byte-level vocabularies write their bytes in."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _word_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[bytes, int]]:
    """Ids and merges of a vocabulary file with word ends, and its tokens as bytes, ends as ``END``."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte, suffix = printable_bytes(), model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    tokens = {}
    for name, i in model["vocab"].items():
        ends = bool(suffix) and name.endswith(suffix)
        stem = name[:-len(suffix)] if ends else name
        if all(c in byte for c in stem):
            tokens[bytes(byte[c] for c in stem) + END * ends] = i
    return model["vocab"], merges, tokens


@functools.lru_cache
def merges_by_id(path: str) -> bool:
    """Whether words can be merged by the ids of the bytes they form (see ``tree_bpe.TreeEncoder``).

    The ids of the merges must rise, those of letters with an end come before them, and every token must
    be the encoding of its own letters: of those that end a word the library's, of the others that of
    the merges applied one by one.
    """
    ids, merges, tokens = _word_vocabulary(path)
    if len(tokens) != len(ids) or any(a + b not in ids for a, b in merges):
        return False
    made = [ids[a + b] for a, b in merges]
    if made != sorted(set(made)) or sorted(set(ids.values()) - set(made)) != list(range(512)):
        return False
    rank = {m: i for i, m in enumerate(merges)}

    def alone(name: str) -> bool:
        parts = list(name)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            if (parts[best], parts[best + 1]) not in rank:
                return False
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return True

    tokenize = load(path).model.tokenize
    return all([t.id for t in tokenize(name[:-4])] == [i] if name.endswith("</w>") else alone(name)
               for name, i in ids.items())


class Words(Segments):
    """Encoder for a vocabulary with word ends that lower-cases and drops white space.

    Words of plain Latin letters with at most one sign after them go to the merges as they stand, all
    those of many texts in one call, with the space that follows in the place of the word's end. Of the
    other segments, those of ASCII signs and Latin letters are parted as the split pattern does and put
    together from the ids of their parts, which are remembered; the rest goes through the library.
    """

    _LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    _PLAIN = re.compile(f"([{_LETTERS}]+)([.,!?;:]*)")
    #: A stretch of plain words, and the segment after it that is none.
    _STRETCH = re.compile(rf"((?:\s*+[{_LETTERS}]{{1,{SHORT}}}+[.,!?;:]?+(?!\S))*+)\s*+(\S*+)")
    _SIMPLE = re.compile(f"[!-~{_LETTERS}]+")
    _PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
    #: White space other than the space; texts with U+001C to U+001F come here only whole.
    _WHITE = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    #: Stand for another segment and for the end of a text; no plain word holds them.
    _OTHER, _CLOSE = "\x02 ", "\x03 "

    def __init__(self, path: str, proven: bool | None = None):
        super().__init__(path, keep_space=False)
        self.coder = None
        if merges_by_id(path) if proven is None else proven:
            tokens = _word_vocabulary(path)[2]
            self.coder = tiktoken.Encoding("words", pat_str=r"\S+", special_tokens={}, mergeable_ranks=tokens)._encode_single_piece
            self.other = max(self.tokenizer.get_vocab().values()) + 1  # added tokens included
            spaced = {t[:-1] + b" " if t.endswith(END) else t: i for t, i in tokens.items()}
            # The special token occurs nowhere; without any, every place would be tried for one.
            self.stretch = tiktoken.Encoding(
                "stretches", pat_str="[^ ]+ ", special_tokens={"\x04": self.other + 2},
                mergeable_ranks=spaced | {self._OTHER.encode(): self.other, self._CLOSE.encode(): self.other + 1})
        self.seen = _Seen(self._one)
        self.stems: dict[str, bytes] = {"": b""}
        self.merges = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The library's own alphabet for the bytes of these letters.
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        pre = self.tokenizer.pre_tokenizer
        self.written = {ord(c): pre.pre_tokenize_str(c)[0][0] for c in letters
                        if c.isalpha() and not c.isascii()}

    def _stem(self, text: str) -> bytes:
        found = self.stems.get(text)
        if found is None:
            if self.coder is not None:
                ids = self.coder(text.encode() + END)
            else:
                ids = [t.id for t in self.merges(text if text.isascii() else text.translate(self.written))]
            found = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
            if len(self.stems) > STEMS:
                self.stems = {"": b""}
            if len(text) <= SHORT:
                self.stems[text] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if self.coder is not None:
            return self.encode_all([text], 0)[0][:-1].tobytes()
        if len(self.seen) > WORDS:
            self.seen.clear()
        return b"".join(map(self.seen.__getitem__, self.segments(text or "")))

    def encode_all(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end_id`` after each, and how many each text has."""
        if self.coder is None:
            each = [self.encode(t) + _PACK[1](end_id) for t in texts]
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)
        if len(self.seen) > WORDS:
            self.seen.clear()
        ids, parts, others, size = [], [], [], 0
        for text in texts:
            text = text or ""
            if _APART.search(text):
                others.append(self._whole(text))
                parts.append(self._OTHER)
            else:
                for plain, other in self._STRETCH.findall(text):
                    parts.append(plain)
                    if other:
                        others.append(self.seen[other])
                        parts.append(" " + self._OTHER)
            parts.append(" " + self._CLOSE)
            size += len(text)
            if size > CHARS:
                ids.append(self._stretches("".join(parts), others))
                parts, others, size = [], [], 0
        if parts:
            ids.append(self._stretches("".join(parts), others))
        found = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        ends = np.flatnonzero(found == self.other + 1)
        found[ends] = end_id
        return found, np.diff(ends, prepend=-1)

    def _stretches(self, text: str, others: list[bytes]) -> np.ndarray:
        """Ids of plain words, with those of the other segments in their places."""
        text = text.lower()
        for c in self._WHITE:
            if c in text:
                text = text.replace(c, " ")
        for c in ".,!?;:":
            text = text.replace(c, " " + c)
        ids = self.stretch.encode_to_numpy(text, disallowed_special=())
        if not others:
            return ids
        there = ids == self.other
        count = np.ones(len(ids), np.int64)
        count[there] = [len(x) // 4 for x in others]
        ids, there = np.repeat(ids, count), np.repeat(there, count)
        ids[there] = np.frombuffer(b"".join(others), "<u4")
        return ids

    def _one(self, segment: str) -> bytes:
        plain = self._PLAIN.fullmatch(segment)
        if plain:
            letters, signs = plain.groups()
            return self._stem(letters.lower()) + self._stem(signs)
        # The library takes added tokens out before it lower-cases.
        if self.coder is None or not self._SIMPLE.fullmatch(segment) or any(t in segment for t in self.added):
            return self._whole(segment)
        return b"".join([self._stem(x) for x in self._PIECE.findall(segment.lower())])


class _Seen(dict):
    """Remembers short segments as they are met."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, segment: str) -> bytes:
        found = self.make(segment)
        if len(segment) <= SHORT:
            self[segment] = found
        return found
