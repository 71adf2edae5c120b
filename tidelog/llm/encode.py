"""Encoding with a public byte-pair tokenizer by prefix dynamic programming.

For every prefix of a piece's bytes there is exactly one token that can end its encoding: the token
whose predecessor, the last token of the shorter prefix, stays beside it when the merges are applied.
The table of these last tokens is all that is stored; an encoding is read off it from the end. As the
table of a prefix does not depend on what follows, appended bytes only extend it, and after an edit
only the pieces around it are worked out again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.texts import slices, spread

TOKENIZERS = os.environ.get("TIDELOG_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte-level tokenizers whose file says use_regex cut text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Characters beyond a piece's end that its match may have looked at.
LOOKS_AHEAD = 3


def _bytes_of_chars() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary file: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def checked(data: bytes) -> dict:
    """The content of a tokenizer file (JSON), if it is one whose rules are those of Encoder; others are refused."""
    spec = json.loads(data)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wanted = {
        "model.type": (model.get("type"), "BPE"), "pre_tokenizer.type": (before.get("type"), "ByteLevel"), "pre_tokenizer.use_regex": (before.get("use_regex", True), True), "pre_tokenizer.add_prefix_space": (before.get("add_prefix_space"), False),
        "normalizer": (spec.get("normalizer"), None), "dropout": (model.get("dropout"), None), "continuing_subword_prefix": (model.get("continuing_subword_prefix") or None, None), "end_of_word_suffix": (model.get("end_of_word_suffix") or None, None),
        "byte_fallback": (bool(model.get("byte_fallback")), False), "ignore_merges": (bool(model.get("ignore_merges")), False),
    }
    wrong = {k: x for k, (x, y) in wanted.items() if x != y}
    if wrong:
        raise ValueError(f"no byte-level tokenizer of this kind: {wrong}")
    return spec


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """A byte-pair vocabulary with its merges, from the content of a tokenizer file (JSON)."""

    def __init__(self, data: bytes):
        model = checked(data)["model"]
        byte = _bytes_of_chars()
        raw = lambda s: bytes(byte[c] for c in s)
        special = set()
        self.id: dict[bytes, int] = {}
        for s, i in model["vocab"].items():
            try:
                self.id[raw(s)] = i
            except KeyError:
                special.add(i)
        self.rank: dict[tuple[int, int], int] = {}  # of the merge of two neighbours
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # rank of the merge that makes a token; single bytes have -1
        for r, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            left, right = self.id[raw(x)], self.id[raw(y)]
            whole = self.id[raw(x) + raw(y)]
            self.rank[left, right] = r
            self.parts.setdefault(whole, (left, right))
            self.made.setdefault(whole, r)
        self.id = {b: i for b, i in self.id.items() if len(b) == 1 or i in self.made}
        self.longest = max(map(len, self.id))
        self.size = {i: len(b) for b, i in self.id.items()}
        self.bytes = {i: b for b, i in self.id.items()}
        self.split = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def compatible(self, x: int, y: int) -> bool:
        """Whether x and y, side by side, stay two tokens: no merge ever joins across their border.

        The merges inside x and y are undone from the last one on. At each moment the two tokens at
        the border are looked at: a merge of them comes first if its rank is below the rank of the
        merge that used up the left one, and not above the one that used up the right one (of equal
        merges the one further left goes first).
        """
        known = self.beside.get((x, y))
        if known is not None:
            return known
        left, right, made = x, y, self.made
        left_used = right_used = len(self.rank)
        ok = True
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < left_used and r <= right_used:
                ok = False
                break
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                left_used, left = a, self.parts[left][1]
            else:
                right_used, right = b, self.parts[right][0]
        if len(self.beside) > 2_000_000:
            self.beside.clear()
        self.beside[x, y] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``data``, given those of its first len(last)-1 bytes; ``last[0]`` is unused."""
        ids, longest = self.id, self.longest
        for end in range(len(last), len(data) + 1):
            found = -1
            for start in range(max(0, end - longest), end):
                t = ids.get(data[start:end])
                if t is not None and (start == 0 or self.compatible(last[start], t)):
                    found = t
                    break
            last.append(found)
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding of the longest prefix in the table."""
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= self.size[last[end]]
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        return self.read(self.extend(piece.encode("utf-8", "replace"), [-1]))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and for the empty text."""
        if not text:
            return []
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes[i] for i in ids)


class Encoded:
    """A text with the table of each piece, kept exact under appends and edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        #: Bytes worked out by the last change; what was kept is not among them.
        self.worked = 0
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.read(t)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]. Pieces that could not see the change keep their tables."""
        old, starts, tables = self.text, self.starts, self.tables
        text = old[:start] + new + old[end:]
        shift = len(new) - (end - start)
        ends = [*starts[1:], len(old)] if starts else []
        keep = 0
        while keep < len(starts) and ends[keep] + LOOKS_AHEAD <= start:
            keep += 1
        at = ends[keep - 1] if keep else 0
        later = {s + shift: k for k, s in enumerate(starts) if s >= end and k >= keep}
        new_starts, new_tables, rest = starts[:keep], tables[:keep], None
        self.worked = 0
        for m in self.encoder.finditer(text, at):
            if m.start() in later and m.start() >= start + len(new):
                rest = later[m.start()]
                break
            data = m.group().encode("utf-8", "replace")
            table = [-1]
            k = keep + len(new_starts) - keep
            if k < len(starts) and starts[k] == m.start():  # the same beginning: the table goes on from it
                before = old[starts[k] : ends[k]].encode("utf-8", "replace")
                n = len(os.path.commonprefix([before, data]))
                table = tables[k][: n + 1]
            self.worked += len(data) + 1 - len(table)
            new_starts.append(m.start())
            new_tables.append(self.encoder.extend(data, table))
        if rest is not None:
            new_starts += [s + shift for s in starts[rest:]]
            new_tables += tables[rest:]
        self.text, self.starts, self.tables = text, new_starts, new_tables


@lru_cache(maxsize=4)
def encoder(data: bytes) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(data)


def encode(docs: DataFrame, id: str, text: str, path: str, ids: str = "ids") -> DataFrame:
    """(id, ids): the token ids of every row's whole text, without special tokens.

    Null and empty texts have an empty list. Strings that look like special tokens are ordinary text.
    Each row gives one row, repeated rows and null ids included; other columns are ignored. There is
    no shuffle; a worker holds the vocabulary and a bounded memory of pieces, whatever the corpus. The
    file at ``path`` is read and checked by the driver and broadcast (1.5 MB).
    """
    data = read_file(path)
    checked(data)
    shipped = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value)
        for b in slices(batches, 2_000_000):
            flat: list[int] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                flat += enc.encode(t)
                ends.append(len(flat))
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["id", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, f"id {kind}, ids array<int>").toDF(id, ids)
