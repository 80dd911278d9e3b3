"""Byte-level BPE encoding and decoding in numpy.

Words of like length lie padded in one matrix of ids.  Each round every row
merges its leftmost pair of minimum rank, pairs being looked up in a hashed
table; rows without a known pair leave the matrix, which closes up.

Defined cases: a null text is an empty one and has no ids; words of any
length are merged exactly (beyond ``LONG_WORD`` bytes with a heap, which
takes the same leftmost pair of minimum rank); rows are encoded one by one,
so repeated rows give equal ids; an empty table gives an empty result; the
rank file is read by the driver and sent to the tasks (a fixed vocabulary).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import process_cache, ragged_gather, text_slices, texts_of

NONE = np.int32(2 ** 31 - 1)
MATRIX_CELLS = 1 << 19
LONG_WORD = 1024
SLICE_BYTES = 1 << 20       # texts encoded at a time (a longer text is one by itself)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing table (left id, right id) -> merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(left))).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]] = keys[put]
            self.values[slots[put]] = merged[put]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none (padding is -1)."""
        shape = left.shape
        out = np.full(left.size, NONE, dtype=np.int32)
        ask = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = (left.ravel()[ask].astype(np.int64) << 32) | right.ravel()[ask].astype(np.int64)
        slots = self._slot(keys)
        while len(ask):
            there = self.keys[slots]
            hit = there == keys
            out[ask[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            ask, keys, slots = ask[on], keys[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Decoder:
    """The bytes of every token of a rank file."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank)
                      for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.token_sizes = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes in a row, bytes per text) of ids in a row."""
        sizes = self.token_sizes[ids]
        data = ragged_gather(self.token_bytes, self.token_starts[ids], sizes)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return data, np.bincount(owner, weights=sizes, minlength=len(lengths)).astype(np.int64)


class Bpe(Decoder):
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        super().__init__(rank_file)
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # any two tokens whose bytes in a row are a token may merge into it
        ranks, left, right, merged = self.ranks, [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64),
                               np.array(merged, dtype=np.int32))
        self.chunks = ChunkEncoder(self.encode_parts)

    # ---- encoding

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a padded matrix to its end: (ids, lengths)."""
        n, width = ids.shape
        out, sizes = np.full((n, width), -1, dtype=np.int32), (ids >= 0).sum(axis=1)
        final = sizes.copy()
        rows = np.arange(n)
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                out[rows[done], :ids.shape[1]] = ids[done]
                final[rows[done]] = sizes[done]
                go = ~done
                ids, ranks, rows, sizes, at, best = ids[go], ranks[go], rows[go], sizes[go], at[go], best[go]
                if not len(rows):
                    break
            sizes = sizes - 1
            keep = int(sizes.max())
            cols = np.arange(keep)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            r = np.arange(len(rows))
            ids[r, at] = best
            cols = cols[:-1]
            ranks = np.take_along_axis(np.concatenate(
                [ranks, np.full((len(rows), 1), NONE)], axis=1), cols + (cols > at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < keep - 1))
                ranks[r[ok], side[ok]] = self.pairs.get(ids[r[ok], side[ok]], ids[r[ok], side[ok] + 1])
        return out, final

    def merge_long(self, word: bytes) -> np.ndarray:
        """One long word: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(i):
            j = after[i]
            return None if j >= n else ranks.get(tokens[ids[i]] + tokens[ids[j]])

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or rank(i) != r:
                continue
            j = after[i]
            ids[i], after[i], gone[j] = r, after[j], 1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k))
        return np.array([ids[i] for i in range(n) if not gone[i]], dtype=np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, lengths) of words, each merged by itself."""
        found: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                found[i] = (whole,)
            elif len(word) > LONG_WORD:
                found[i] = self.merge_long(word)
            else:
                buckets.setdefault(2 * (-(-len(word) // 2)) if len(word) <= 16 else
                                   1 << (len(word) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for lo in range(0, len(members), step):
                own = members[lo:lo + step]
                sizes = np.fromiter((len(words[i]) for i in own), dtype=np.int64, count=len(own))
                flat = self.byte_ids[np.frombuffer(b"".join(words[i] for i in own), dtype=np.uint8)]
                matrix = np.full((len(own), width), -1, dtype=np.int32)
                matrix[np.arange(width) < sizes[:, None]] = flat
                ids, lengths = self.merge_rows(matrix)
                for i, row, n in zip(own, ids, lengths.tolist()):
                    found[i] = row[:n]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return (np.concatenate(found).astype(np.int32) if len(found) else np.zeros(0, dtype=np.int32)), sizes

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids per part): each match of the pattern by itself."""
        number: dict[str, int] = {}
        words_of = [[number.setdefault(w, len(number)) for w in self.find(p)] for p in parts]
        ids, sizes = self.encode_words([w.encode() for w in number])
        starts = np.cumsum(sizes) - sizes
        counts = np.fromiter(map(len, words_of), dtype=np.int64, count=len(words_of))
        flat = np.fromiter((w for ws in words_of for w in ws), dtype=np.int64, count=int(counts.sum()))
        owner = np.repeat(np.arange(len(parts)), counts)
        n_ids = np.bincount(owner, weights=sizes[flat], minlength=len(parts)).astype(np.int64)
        return ragged_gather(ids, starts[flat], sizes[flat]), n_ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks.encode(texts)


def load(rank_file: bytes, pattern: str | None = None) -> Decoder:
    """One encoder per process and vocabulary, or without a pattern a
    decoder, which needs no merges."""
    key = hashlib.sha256(rank_file + (pattern or "").encode()).digest()
    cache = process_cache()
    if key not in cache:
        cache[key] = Decoder(rank_file) if pattern is None else Bpe(rank_file, pattern)
    return cache[key]


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _ranks(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _id_lists(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(lengths), pa.array(ids))


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes),
                                       [None, _offsets(sizes).buffers()[1], pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    ranks = _ranks(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks.value, pattern)
        for part in text_slices(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(*bpe.encode(texts_of(part)))],
                                             ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, ids, decoded binary) from (doc_id, ids)."""
    ranks = _ranks(encoded, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(ranks.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                column = part.column(1)
                lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                decoded = _binaries(*decoder.decode(column.flatten().to_numpy(), lengths))
                yield pa.RecordBatch.from_arrays([part.column(0), column, decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): every whole text encoded and its ids decoded
    again, in one pass of one process a core."""
    ranks = _ranks(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks.value, pattern)
        for part in text_slices(batches, SLICE_BYTES):
            ids, lengths = bpe.encode(texts_of(part))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _id_lists(ids, lengths), _binaries(*bpe.decode(ids, lengths))],
                ["doc_id", "ids", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")
