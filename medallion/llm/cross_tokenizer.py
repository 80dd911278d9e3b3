"""Cross-tokenizer alignment by products of sparse matrices.

The tokens of two tokenizers A and B over the same bytes give two incidence
matrices, token by byte, held as compressed sparse rows built here by hand.
Row by row (Gustavson) the product A.Bt yields the overlap links: which
tokens share bytes, and how many.  Offsets where a token of both ends cut the
text into groups; the product of the token by group incidences yields the
shared-group links.  Products are made in strips of rows of a bounded number
of terms, so a long text needs no more memory than its arrays.

``align`` returns tokens, offsets, overlap links and groups; ``group_links``
the shared-group links; ``link_scores`` how firmly the corpus binds them: a
link is an overlap link whose two tokens end together, the count of an id
pair is how many links of all documents hold it.  The pair table is made by
Spark from counts of each task and dealt to the tasks in blocks of a fixed
size, each broadcast by itself; a document's sums over the blocks add up.

Texts are encoded as a space and the text; tokenizer A is told so, B adds the
space itself.  Long texts reach the libraries cut between words, where both
vocabularies cannot join (checked for B), which gives the same ids.

Defined cases: a null or empty text, and one whose joined token bytes differ
from space and text, has no tokens, no groups, no links and the digest '';
strings of special tokens are plain text; rows are taken one by one, so
repeated rows and null ids each give a row; no rows give none.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .chunks import LibraryEncoder, flatten
from .common import process_cache, ragged_gather, share, shared_value, staged, text_slices, texts_of

SLICE_BYTES = 1 << 18       # texts of one alignment (a longer text is one by itself)
STRIP_TERMS = 1 << 20       # terms of a product at a time
PART_CHARS = 1 << 16        # texts are cut between words beyond
MAX_CACHED, MAX_CHARS = 100_000, 1 << 20    # chunks of A that a process keeps, and their characters
PAIRS_HELD = 1 << 20        # distinct pairs that a task holds before it hands them on
BLOCK_PAIRS = 1 << 21       # pairs in one broadcast, at most (36 MB)
ROW_GROUP = 16 << 20        # bytes of links that a writer holds
ID_BITS = 32


# ---------------------------------------------------------------- matrices

@dataclass
class Csr:
    """Zeros and ones in compressed sparse rows."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        counts = np.bincount(self.columns, minlength=self.width)
        rows = np.repeat(np.arange(len(self)), np.diff(self.starts))
        if not (self.columns[1:] >= self.columns[:-1]).all():
            rows = rows[np.argsort(self.columns, kind="stable")]
        return Csr(np.append(0, np.cumsum(counts)), rows, len(self))


def products(a: Csr, bt: Csr, terms: int = STRIP_TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of A.Bt, strip after strip of rows: every row of
    A adds up the rows of Bt that its columns name."""
    sizes = np.diff(bt.starts)
    work = np.append(0, np.cumsum(sizes[a.columns]))[a.starts]
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + terms, side="right")) - 1)
        columns = a.columns[a.starts[lo]:a.starts[hi]]
        n = sizes[columns]
        found = ragged_gather(bt.columns, bt.starts[columns], n)
        rows = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.starts[lo:hi + 1])), n)
        key = rows * bt.width + found
        if not (key[1:] >= key[:-1]).all():
            key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        yield key[first] // bt.width, key[first] % bt.width, np.diff(np.append(first, len(key)))
        lo = hi


def token_bytes(ends: np.ndarray) -> Csr:
    """Token by byte: each token covers the bytes up to its end."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends), np.arange(n), n)


def token_groups(group: np.ndarray, n_groups: int) -> Csr:
    """Token by group."""
    return Csr(np.arange(len(group) + 1), group, n_groups)


class Alignment:
    """Two token sequences over the same bytes, by the ends of the tokens."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        self.a_ends, self.b_ends = a_ends, b_ends
        at_b = np.zeros(int(b_ends[-1]) + 1 if len(b_ends) else 1, dtype=bool)
        at_b[b_ends] = True
        self.cuts = a_ends[at_b[a_ends]]                    # where tokens of both end
        self.a_group, self.b_group = np.searchsorted(self.cuts, a_ends), np.searchsorted(self.cuts, b_ends)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return products(token_bytes(self.a_ends), token_bytes(self.b_ends).transposed())

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(self.cuts)
        return products(token_groups(self.a_group, n), token_groups(self.b_group, n).transposed())

    def members(self) -> tuple[Csr, Csr]:
        """Group by token, of A and of B."""
        n = len(self.cuts)
        return token_groups(self.a_group, n).transposed(), token_groups(self.b_group, n).transposed()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlap links whose tokens end together."""
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a, b, _ in self.overlaps():
            together = self.a_ends[a] == self.b_ends[b]
            left.append(a[together])
            right.append(b[together])
        return np.concatenate(left), np.concatenate(right)


# -------------------------------------------------------------- tokenizers

def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: visible
    ones as themselves, the others as the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(other)}}


class TokenTable:
    """Bytes of every id, in a row."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return ragged_gather(self.data, self.starts[ids], self.sizes[ids])


def decimals(n: int) -> TokenTable:
    """The numbers below ``n`` in decimal, kept by the process."""
    cache = process_cache()
    if len(cache.get("decimals", TokenTable([])).sizes) < n:
        cache["decimals"] = TokenTable([str(i).encode() for i in range(n)])
    return cache["decimals"]


class Tokenizers:
    """The two tokenizers from the contents of their files."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import re

        import sentencepiece

        self.a = LibraryEncoder(a_file, MAX_CACHED, MAX_CHARS, special_tokens=False)
        names = self.a.tokenizer.get_vocab(with_added_tokens=True)
        byte_of, entries = byte_characters(), [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            entries[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        self.a_table = TokenTable(entries)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_table = TokenTable([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
                                   p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # a space after a letter, digit, comma or full stop and before a
        # letter or digit begins a token of A, and of B if no piece holds one
        # after something else
        self.narrow = max(len(entries), len(pieces)) <= 1 << 16
        self.space = re.compile("(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """A text cut before spaces between words, which are left out."""
        out, at = [], 0
        while self.cuts and len(text) - at > PART_CHARS and (m := self.space.search(text, at + PART_CHARS)):
            out.append(text[at:m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[tuple, tuple]:
        """(ids in a row, ids per text) of A and of B; empty texts have none."""
        parts = [self.parts(t) if t else [] for t in texts]
        flat = [p for of in parts for p in of]
        owner = np.repeat(np.arange(len(texts)), [len(of) for of in parts])
        out = []
        for ids, n in (self.a.encode(flat, spaced=True), flatten(self.b.encode(flat, num_threads=1) if flat else [])):
            out.append((ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)))
        return out[0], out[1]


def load(a_file: bytes, b_file: bytes) -> Tokenizers:
    """One pair of tokenizers per process and pair of files."""
    key, cache = hashlib.sha256(a_file + b"|" + b_file).digest(), process_cache()
    if key not in cache:
        cache[key] = Tokenizers(a_file, b_file)
    return cache[key]


class Slice:
    """Tokens of some texts, one after another, and their alignment."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        (a, self.n_a), (b, self.n_b) = tokenizers.encode(texts)
        raw = [(" " + t).encode() if t else b"" for t in texts]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        same = np.ones(len(texts), dtype=bool)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        for ids, n, table in ((a, self.n_a, tokenizers.a_table), (b, self.n_b, tokenizers.b_table)):
            owner = np.repeat(np.arange(len(texts)), n)
            same &= np.bincount(owner, weights=table.sizes[ids], minlength=len(texts)).astype(np.int64) == sizes
            fit = np.repeat(same, n)
            if not np.array_equal(table.joined(ids[fit]), data[np.repeat(same, sizes)]):
                at, ends = np.cumsum(n) - n, np.cumsum(n)
                for i in np.flatnonzero(same):
                    same[i] = table.joined(ids[at[i]:ends[i]]).tobytes() == raw[i]
        self.a, self.n_a = a[np.repeat(same, self.n_a)], np.where(same, self.n_a, 0)
        self.b, self.n_b = b[np.repeat(same, self.n_b)], np.where(same, self.n_b, 0)
        self.bytes = np.where(same, sizes, 0)
        self.alignment = Alignment(np.cumsum(tokenizers.a_table.sizes[self.a]),
                                   np.cumsum(tokenizers.b_table.sizes[self.b]))
        self.ends = np.cumsum(self.bytes)

    def per_text(self, offsets: np.ndarray) -> np.ndarray:
        """How many of these end offsets lie in each text."""
        return np.bincount(np.searchsorted(self.ends, offsets), minlength=len(self.bytes))

    def group_digests(self) -> list[str]:
        """sha256 of every text's ``a1,a2|b1;a3|b2,b3``, '' without tokens."""
        of_a, of_b = self.alignment.members()
        n = len(self.a) + len(self.b)
        ids, marks = np.zeros(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        # tokens of A stand after those of B of earlier groups, and so on
        a_at = np.arange(len(self.a)) + of_b.starts[self.alignment.a_group]
        b_at = np.arange(len(self.b)) + of_a.starts[self.alignment.b_group + 1]
        ids[a_at], ids[b_at] = self.a, self.b
        if n:
            marks[a_at[of_a.starts[1:] - 1]], marks[b_at[of_b.starts[1:] - 1]] = ord("|"), ord(";")
        decimal = decimals(int(ids.max(initial=0)) + 1)
        hashes = [hashlib.sha256() for _ in self.bytes]
        tokens = np.cumsum(self.n_a + self.n_b)
        doc = 0
        for lo in range(0, n, STRIP_TERMS):
            own = ids[lo:lo + STRIP_TERMS]
            sizes = decimal.sizes[own] + 1
            ends = np.cumsum(sizes)
            text = np.zeros(int(ends[-1]), dtype=np.uint8)
            text[ends - 1] = marks[lo:lo + STRIP_TERMS]
            digits = np.ones(len(text), dtype=bool)
            digits[ends - 1] = False
            text[digits] = decimal.joined(own)
            view = memoryview(text)
            at = 0
            while doc < len(tokens) and at < len(own):
                upto = min(int(tokens[doc]) - lo, len(own))
                if upto > at:
                    last = upto == tokens[doc] - lo       # no mark after the last group
                    hashes[doc].update(view[int(ends[at - 1]) if at else 0:int(ends[upto - 1]) - last])
                    at = upto
                if tokens[doc] - lo > len(own):
                    break
                doc += 1
        return [h.hexdigest() if m else "" for h, m in zip(hashes, self.n_a + self.n_b)]


# ---------------------------------------------------------------- operator

def _files(spark: SparkSession, *paths: str):
    contents = []
    for path in paths:
        with open(path, "rb") as f:
            contents.append(f.read())
    return spark.sparkContext.broadcast(contents)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths))), pa.array(values)).cast(
        pa.list_(pa.from_numpy_dtype(values.dtype)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, a_ids, a_ends, b_ids, b_ends, overlap_a, overlap_b,
    overlap_bytes, group_ends): ids and end offsets (in bytes of space and
    text) of the tokens, the overlap links by the tokens' places with the
    bytes shared, and the end offset of every group."""
    files = _files(docs.sparkSession, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*files.value)
        for part in text_slices(batches, slice_bytes):
            own = Slice(both, texts_of(part))
            al, starts = own.alignment, own.ends - own.bytes
            a0, b0 = np.cumsum(own.n_a) - own.n_a, np.cumsum(own.n_b) - own.n_b
            none = (np.zeros(0, dtype=np.int64),) * 3
            a, b, n = (np.concatenate(x) for x in zip(none, *al.overlaps()))
            of = np.searchsorted(own.ends, al.a_ends)
            per_link = np.bincount(of[a], minlength=len(own.bytes))
            groups = own.per_text(al.cuts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists(own.a, own.n_a), _lists(al.a_ends - np.repeat(starts, own.n_a), own.n_a),
                 _lists(own.b, own.n_b), _lists(al.b_ends - np.repeat(starts, own.n_b), own.n_b),
                 _lists(a - np.repeat(a0, per_link), per_link), _lists(b - np.repeat(b0, per_link), per_link),
                 _lists(n, per_link), _lists(al.cuts - np.repeat(starts, groups), groups)],
                ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "overlap_a", "overlap_b", "overlap_bytes",
                 "group_ends"])

    return _texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, "
             "overlap_a array<long>, overlap_b array<long>, overlap_bytes array<long>, group_ends array<long>")


def group_links(aligned: DataFrame) -> DataFrame:
    """(doc_id, group, a, b): the shared-group links of aligned documents,
    by the places of the tokens, a strip of the product at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, a_ends, b_ends in zip(*(batch.column(i) for i in range(3))):
                al = Alignment(*(np.asarray(e.as_py() or [], dtype=np.int64) for e in (a_ends, b_ends)))
                for a, b, _ in al.shared():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * len(a), pa.int64()), pa.array(al.a_group[a]), pa.array(a), pa.array(b)],
                        ["doc_id", "group", "a", "b"])

    return aligned.select("doc_id", "a_ends", "b_ends").mapInArrow(run, "doc_id long, group long, a long, b long")


class PairCounts:
    """Counts of keys, few at a time."""

    def __init__(self):
        self.keys = self.counts = np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, counts = np.unique(keys, return_counts=True)
        keys = np.concatenate([self.keys, new])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, weights=np.concatenate([self.counts, counts]),
                                  minlength=len(self.keys)).astype(np.int64)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.counts)], ["pair", "n"])


def _packed_links(a: np.ndarray, b: np.ndarray, n_links: np.ndarray, narrow: bool) -> pa.Array:
    """The id pairs of every text's links, as bytes: 16 bits an id if both
    vocabularies are that small, else 32."""
    data = np.stack([a, b], axis=1).astype("<u2" if narrow else "<u4")
    ends = np.append(0, np.cumsum(n_links)) * data.itemsize * 2
    return pa.BinaryArray.from_buffers(pa.binary(), len(n_links), [
        None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _pairs(links: pa.Array, n_links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pair keys of all links of a batch, and links per row."""
    n = n_links.to_numpy()
    data = b"".join(links.to_pylist())
    total = int(n.sum())
    ids = np.frombuffer(data, dtype="<u2" if len(data) == 4 * total else "<u4").reshape(-1, 2).astype(np.int64)
    return ids[:, 0] << ID_BITS | ids[:, 1], n


def pair_table(links: DataFrame) -> DataFrame:
    """(pair, b, n, best): how many links hold an id pair, and whether that
    is the highest count of its B id.  Tasks count first; the highest counts
    are a row for each id of B's vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PairCounts()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                held.add(_pairs(*batch.slice(lo, 500).columns)[0])
                if len(held.keys) > PAIRS_HELD:
                    yield held.batch()
                    held = PairCounts()
        yield held.batch()

    counts = links.select("links", "n_links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1))
    counts = staged(counts, "token-pairs")
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select(
        "pair", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _table_blocks(table: DataFrame, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pair table in blocks of at most ``pairs``, by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            for lo in range(0, batch.num_rows, pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[lo:lo + pairs].tobytes()], pa.binary()) for c in columns], ["pair", "n", "best"])

    held: list = []
    size = 0
    for r in table.select("pair", "n", "best").mapInArrow(run, "pair binary, n binary, best binary").toLocalIterator():
        n = len(r["best"])
        if held and size + n > pairs:
            yield _by_key(held)
            held, size = [], 0
        held.append(tuple(r))
        size += n
    if held:
        yield _by_key(held)


def _by_key(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts, best = (np.frombuffer(b"".join(h[i] for h in held), dtype=t)
                          for i, t in enumerate((np.int64, np.int64, np.bool_)))
    order = np.argsort(keys)
    return keys[order], counts[order], best[order]


def link_scores(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                slice_bytes: int = SLICE_BYTES, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256): tokens, groups and links of every document, the links
    whose count is the highest of their B id, the sum of the counts, and the
    digest of the groups."""
    spark = docs.sparkSession
    files = _files(spark, a_path, b_path)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*files.value)
        for part in text_slices(batches, slice_bytes):
            own = Slice(both, texts_of(part))
            al = own.alignment
            a, b = al.links()
            n_links = own.per_text(al.a_ends[a])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(own.n_a), pa.array(own.n_b), pa.array(own.per_text(al.cuts)),
                 pa.array(n_links), pa.array(own.group_digests()),
                 _packed_links(own.a[a], own.b[b], n_links, both.narrow)],
                ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    kept = ("doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "links binary")
    path = scratch_path(spark, "token-links")
    # small row groups: a task's writer holds one in memory
    _texts(docs, id_col, text_col).mapInArrow(tokens, kept).write.option(
        "parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    found = spark.read.schema(kept).parquet(path)
    folder, schema = scratch_path(spark, "link-scores"), "row long, n_best long, count_sum long"
    spark.createDataFrame([], schema).write.parquet(folder)
    links = found.select("row", "links", "n_links")
    for held in _table_blocks(pair_table(found), block_pairs):
        block = share(spark, held)

        def score(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            keys, counts, best = shared_value(block)
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    pairs, n = _pairs(part.column(1), part.column(2))
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    hit = keys[at] == pairs
                    owner = np.repeat(np.arange(part.num_rows), n)
                    firm = np.bincount(owner, weights=hit & best[at], minlength=part.num_rows).astype(np.int64)
                    total = np.zeros(part.num_rows, dtype=np.int64)
                    np.add.at(total, owner[hit], counts[at[hit]])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(firm), pa.array(total)],
                                                     ["row", "n_best", "count_sum"])

        links.mapInArrow(score, schema).write.mode("append").parquet(folder)
        block.destroy()
    sums = spark.read.schema(schema).parquet(folder).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
