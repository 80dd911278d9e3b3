"""Benchmark decontamination by SimHash over item-sized windows.

A document's windows of as many words as a benchmark item has are
fingerprinted (SimHash of their word shingles); multi-index Hamming blocks
find every item fingerprint within the radius of a window's; each candidate
is then verified by exact weighted-shingle similarity (weighted Jaccard of
the shingle counts), at 0.8 or more.

With radius ``r`` and ``b`` blocks, two fingerprints within ``r`` bits agree
in some block up to ``r // b`` bits; each block has a table from its value to
the items that near, so no fingerprint within the radius is missed.

A window that shares no shingle with an item of its length has similarity
zero with all of them; windows are therefore formed around the shingles that
occur in some item, over the whole text.  Nothing else is skipped.

Defined cases: null or empty texts and items without words match nothing;
items of fewer words than a shingle count as one shingle of their whole
sequence; of equal similarities the smaller item id, then the earlier window
is reported; repeated rows are reported once each, equal items count once;
null item ids are kept as null; an empty benchmark or document table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import id_text, text_slices, texts_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
ITEMS_PER_BLOCK = 20_000        # items sent to the tasks at once
STRIP = 1 << 16                 # shingles whose windows are formed at once

WORD = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
FLAG_BITS = 22
FLAG_MASK = np.uint64((1 << FLAG_BITS) - 1)


def normal_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _WordHashes(dict):
    """Word -> 64-bit hash, computed once per word."""

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of a row of word hashes (fewer words:
    the whole sequence as one)."""
    k = min(k, len(words))
    if not k:
        return words[:0]
    n = len(words) - k + 1
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        acc = mix(acc * _MUL + words[i:i + n])
    return acc


def simhash_windows(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows ``hashes[s:s + size]``: a bit is set where
    over half of the window's shingles have it."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    total = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    votes = total[starts + size] - total[starts]
    return np.packbits(2 * votes > size, axis=1).view(">u8")[:, 0].astype(np.uint64)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class BlockTables:
    """Multi-index Hamming search over the fingerprints of one group of items."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.fps, self.radius = fps, radius
        self.width = 64 // blocks
        spread = min(radius // blocks, self.width)
        values = np.arange(1 << self.width, dtype=np.uint64)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= spread
        # per block: value -> items whose block lies near it
        self.tables = []
        for b in range(blocks):
            own = self._block(fps, b).astype(np.int64)
            rows, items = np.nonzero(near[:, own])
            first = np.searchsorted(rows, np.arange(len(values) + 1))
            self.tables.append((first, items))

    def _block(self, fps: np.ndarray, b: int) -> np.ndarray:
        return (fps >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all pairs within the radius."""
        found = []
        for b, (first, items) in enumerate(self.tables):
            value = self._block(queries, b).astype(np.int64)
            counts = first[value + 1] - first[value]
            q = np.repeat(np.arange(len(queries)), counts)
            at = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[value], counts)
            i = items[at]
            ok = np.bitwise_count(queries[q] ^ self.fps[i]) <= self.radius
            found.append(q[ok] * len(self.fps) + i[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.fps)), pairs % max(1, len(self.fps))


class Benchmark:
    """Items prepared for the search: by number of words, fingerprints in
    block tables and shingle counts; and the sorted shingles of all items."""

    def __init__(self, items: list[tuple], k: int = SHINGLE_WORDS, radius: int = RADIUS,
                 similarity: float = SIMILARITY):
        self.k, self.similarity = k, similarity
        self.word_hash = _WordHashes()
        rows = []
        for item_id, text in items:
            words = self.hashes(normal_words(text or ""))
            if len(words):
                rows.append((len(words), item_id, shingles(words, k)))
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        self.groups = {}                       # words -> (ids, counts, tables)
        self.known = {}                        # shingle length -> (sorted shingles, item words)
        self.maybe = {}                        # shingle length -> low bits of its shingles
        for size in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == size]
            fps = np.concatenate([simhash_windows(h, np.zeros(1, dtype=np.int64), len(h)) for _, _, h in own])
            self.groups[size] = ([i for _, i, _ in own], [Counter(h.tolist()) for _, _, h in own],
                                 BlockTables(fps, radius))
        for width in {min(size, k) for size in self.groups}:
            pairs = {(int(s), size) for size, _, h in rows if min(size, k) == width for s in h}
            order = sorted(pairs)
            self.known[width] = (np.array([s for s, _ in order], dtype=np.uint64),
                                 np.array([z for _, z in order], dtype=np.int64))
            self.maybe[width] = np.zeros(1 << FLAG_BITS, dtype=bool)
            self.maybe[width][(self.known[width][0] & FLAG_MASK).astype(np.int64)] = True

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.word_hash.__getitem__, words), dtype=np.uint64, count=len(words))

    def anchors(self, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, item words) where the row of shingles has one of the items."""
        known, sizes = self.known[width]
        hit = np.flatnonzero(self.maybe[width][(row & FLAG_MASK).astype(np.int64)])
        lo, hi = (np.searchsorted(known, row[hit], side=side) for side in ("left", "right"))
        counts = hi - lo
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        return np.repeat(hit, counts), sizes[at]

    def texts_with_anchors(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which of the texts (word hashes in a row) hold a shingle of an item."""
        ends = np.cumsum(lengths)
        found = []
        for width in self.known:
            if len(words) >= width:
                places = self.anchors(shingles(words, width), width)[0]
                owner = np.searchsorted(ends, places, side="right")
                found.append(owner[places + width <= ends[owner]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def matches(self, words: np.ndarray) -> list[tuple]:
        """(item_id, similarity, first word, words) of every item that the
        document holds, at its best window."""
        best: dict = {}
        for width in self.known:
            if len(words) < width:
                continue
            row = shingles(words, width)
            places, sizes = self.anchors(row, width)
            for size in np.unique(sizes).tolist():
                span = size - width + 1                # shingles of a window
                last = len(row) - span
                if last < 0:
                    # the text is shorter than the item: it is the one window
                    starts, span = np.zeros(1, dtype=np.int64), len(row)
                else:
                    starts = window_starts(places[sizes == size], span, last)
                ids, counts, tables = self.groups[size]
                for strip in strips(starts):
                    lo, hi = int(strip[0]), int(strip[-1]) + span
                    fps = simhash_windows(row[lo:hi], strip - lo, span)
                    held = (-1, None)
                    for q, i in zip(*(x.tolist() for x in tables.search(fps))):
                        s = int(strip[q])
                        if held[0] != s:
                            held = (s, Counter(row[s:s + span].tolist()))
                        similarity = weighted_jaccard(held[1], counts[i])
                        if similarity >= self.similarity:
                            key = (size, i)
                            if key not in best or similarity > best[key][1]:
                                best[key] = (ids[i], similarity, s, span + width - 1)
        return list(best.values())


def window_starts(places: np.ndarray, span: int, last: int) -> np.ndarray:
    """Starts (0 to ``last``) of the windows of ``span`` shingles that hold
    one of these places."""
    steps = np.zeros(last + 2, dtype=np.int64)
    np.add.at(steps, np.maximum(places - span + 1, 0), 1)
    np.add.at(steps, np.minimum(places, last) + 1, -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def strips(starts: np.ndarray, room: int = STRIP) -> Iterator[np.ndarray]:
    """Ascending starts in strips that span at most ``room`` shingles."""
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + room))
        yield starts[lo:hi]
        lo = hi


def item_blocks(items: DataFrame, per_block: int) -> Iterator[list[tuple]]:
    """The distinct items in blocks of about ``per_block``, dealt by a hash
    of item and text, so neither an id nor its absence fills one.  A block is
    fetched when its turn comes."""
    items = items.distinct()
    n = -(-items.count() // per_block)
    place = F.pmod(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"), F.lit(max(n, 1)))
    for i in range(n):
        yield [tuple(r) for r in items.where(place == i).collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
                       radius: int = RADIUS, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): one row per
    document row and item found in it.  The benchmark goes to the tasks in
    blocks of about ``items_per_block`` items; if there are several, each one's
    matches are written before the next is fetched."""
    docs = id_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    spark = docs.sparkSession
    items = id_text(benchmark, item_col, item_text_col)

    def search(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value, shingle_words, radius, similarity)
            for part in text_slices(batches):
                words = [bench.hashes(normal_words(t)) for t in texts_of(part)]
                lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                doc_ids, rows = part.column(0).to_pylist(), []
                for i in bench.texts_with_anchors(np.concatenate(words), lengths).tolist():
                    rows += [(doc_ids[i], *match) for match in bench.matches(words[i])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (
                            pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return docs.mapInArrow(run, schema)

    blocks = item_blocks(items, items_per_block)
    first = next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    second = next(blocks, None)
    if second is None:
        return search(first)
    folder = scratch_path(spark, "contamination")
    for block in itertools.chain([first, second], blocks):
        search(block).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
