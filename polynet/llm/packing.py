"""Packing documents into token sequences: best-fit decreasing.

Documents longer than a window are first cut into full windows; the rest of
each document goes to the open window with the least room that still holds it,
longest pieces first. A segment tree over remaining capacity finds that window.

Pieces are dealt at random into groups of bounded size, each packed by one
task; a group has thousands of pieces, so it wastes as little as one packing of
all would, and sequences are numbered through all groups.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, keep, keep_observed, parts, with_before

WINDOW, END_ID, GROUP_PIECES = 2048, 1, 5000
#: Characters of words whose ids a worker remembers, and bytes of text that it works on at once (one text at least).
CACHE_CHARS, BATCH_BYTES = 6_000_000, 500_000
#: A space before a visible character always starts a token of its own with what follows, so texts may be cut there.
_CUT = re.compile(r" (?=\S)")


class WordTokenizer:
    """A byte-level BPE of the `tokenizers` library that remembers the ids of words. Same ids as for the whole text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # tokens that begin with a space, which a byte-level vocabulary writes as U+0120
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "")[:1] == "\u0120" for i in range(self.tokenizer.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str], most: int = CACHE_CHARS) -> list[np.ndarray]:
        if self.chars > most:
            self.forget()
        split = [t.split(" ") for t in texts]
        known = self.known  # by the word without the space that stands before it
        new = {p for words in split for p in words[1:] if p not in known}
        uncut = {p for p in new if not p or p[0].isspace()}
        if uncut:  # a space before white space or at the end is no place to cut
            split = [words if uncut.isdisjoint(words[1:]) else _CUT.split(t) for t, words in zip(texts, split, strict=True)]
            new = {p for words in split for p in words[1:] if p not in known}
        new = list(new)
        plain = [p for p in new if p.split() == [p]]
        for at in range(0, len(plain), 512):
            known.update(self._ids_of_words(plain[at : at + 512]))
        odd = [p for p in new if p not in known]
        known.update(zip(odd, self._ids([f" {p}" for p in odd]), strict=True))
        self.chars += sum(map(len, new))
        starts = self._ids([words[0] for words in split])
        of = known.__getitem__
        return [np.frombuffer(start + b"".join(map(of, words[1:])), "<u4") for start, words in zip(starts, split, strict=True)]

    def _ids_of_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words without white space inside, each as after a space: in one call, each word's first token has the space."""
        found = self.tokenizer.encode_batch_fast(["".join([f" {p}" for p in words])], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        cuts = np.flatnonzero(self.spaced[ids])
        raw, cuts = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return {p: raw[a:b] for p, a, b in zip(words, cuts[:-1], cuts[1:], strict=True)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class CapacityTree:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest that holds a length."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of an open window with the least room of at least `length`, taken out; None if there is none."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece, given from the longest down, and the number of windows."""
    tree, number, windows, offsets = CapacityTree(window), 0, [], []
    for n in lengths:
        found = tree.take(n)
        room, w = found or (window, number)
        number += found is None
        windows.append(w)
        offsets.append(window - room)
        if room > n:
            tree.add(room - n, w)
    return windows, offsets, number


def pieces(docs: DataFrame, key: str, text: str, path: str, window: int, end_id: int, with_ids: bool, cache_chars: int) -> DataFrame:
    """Documents as token pieces: full windows, then the rest. A null text is empty and has the end id alone."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start long, length int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for batch in batches:
            for a, b in blocks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + 1, BATCH_BYTES):
                part = batch.slice(a, b - a)
                rows, columns = [], []
                for i, ids in enumerate(known.encode([t or "" for t in part.column(1).to_pylist()], cache_chars)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                        columns.append(piece.astype(np.int32))
                owner, *numbers = zip(*rows, strict=True)
                arrays = [part.column(0).take(pa.array(owner)), *[pa.array(x, k) for x, k in zip(numbers, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns, pa.list_(pa.int32()))] * with_ids, [key, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, path: str | None = None, group_pieces: int = GROUP_PIECES, with_ids: bool = False, cache_chars: int = CACHE_CHARS) -> DataFrame:
    """One row a piece: `key`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset` (and `ids`).

    Each document is its text's ids and the end id; each id lies in exactly
    one piece. Null and empty texts are the end id alone. Rows with equal keys
    are documents of their own. Extra columns are ignored. A worker remembers
    the ids of words of `cache_chars` characters together. Sequence numbers
    are gapless over the whole table; an empty table gives an empty result.
    """
    numbered = pieces(docs, key, text, path or public_tokenizers.path("byte_bpe_50k.json"), window, end_id, with_ids, cache_chars).withColumn("_piece", F.monotonically_increasing_id())
    cut, (n_pieces, _) = keep_observed(numbered, "pieces")
    groups = parts(n_pieces, group_pieces)
    grouped = cut.withColumn("pack", F.pmod(F.xxhash64("_piece"), F.lit(groups))).drop("_piece")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (key, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        windows, offsets, _ = best_fit(table.column("length").to_pylist(), window)
        return table.append_column("sequence_id", pa.array(windows, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    packed = keep(grouped.groupBy("pack").applyInArrow(run, f"{_ddl(grouped)}, sequence_id long, offset long"), "packed")
    sizes = packed.groupBy("pack").agg((F.max("sequence_id") + 1).alias("windows"))
    base = with_before(sizes, [], "pack", "windows", "base").drop("windows")
    return packed.join(base, "pack").withColumn("sequence_id", F.col("sequence_id") + F.col("base")).drop("pack", "base")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def padded_length(length: Column, window: int = WINDOW) -> Column:
    """A sequence's length after padding: its own if that is a power of two, else the window."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(window))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Token arrays of whole sequences, padded, from `pack(..., with_ids=True)`: `sequence_id`, `n_tokens`, `tokens`."""
    gathered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    tokens = F.flatten(F.transform("pieces", lambda p: p["ids"]))
    out = gathered.select("sequence_id", F.size(tokens).alias("n_tokens"), tokens.alias("tokens"))
    return out.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(pad_id), padded_length(F.col("n_tokens"), window) - F.col("n_tokens"))))
