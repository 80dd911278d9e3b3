"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are sorted by their population counts (one count per
16-bit word) and cut into tiles of bounded size.  Two tiles are compared
only if their population counts allow a distance within the radius: one
differing bit changes one count by one, so the counts of two fingerprints
within ``radius`` bits differ by at most ``radius`` in sum.  A pair of tiles
is compared whole with an exclusive or and bit counts in numpy, in strips of
bounded memory, and leaves only a spanning forest of its links.

Defined cases: a null text is an empty one; a text without words has
fingerprint zero and links like any other; repeated rows stay repeated; a
null id belongs to its component but never names it (the component id is
null only if every id in it is null); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_list, id_text, staged, text_slices
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
TILE_ROWS = 4096
STRIP_CELLS = 1 << 20

#: bits of every byte value, most significant first
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority_bits(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit word per owner: a bit is set if it is set in over half of
    the owner's hashes (an owner without hashes gets zero)."""
    out = np.zeros((n, 8), dtype=np.uint8)
    count = np.bincount(owner, minlength=n)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for b in range(8):
        hist = np.bincount(owner * 256 + octets[:, b], minlength=n * 256).reshape(n, 256)
        set_bits = hist @ _BYTE_BITS
        out[:, b] = np.packbits(2 * set_bits > count[:, None], axis=1)[:, 0]
    return out.view(">u8")[:, 0].astype(np.uint64)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of every k-word shingle (fewer words: the whole sequence)."""
    import xxhash

    words = text.lower().split()          # bytes: lowers A-Z, splits at [\x20\x09-\x0D]
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(b" ".join(words), SEED)]
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))]


def simhash_texts(texts: list[bytes], k: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints (unsigned 64-bit) of texts given as UTF-8."""
    per_text = [shingle_hashes(t, k) for t in texts]
    sizes = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
    flat = np.fromiter(itertools.chain.from_iterable(per_text), dtype=np.uint64, count=int(sizes.sum()))
    return majority_bits(flat, np.repeat(np.arange(len(texts)), sizes), len(texts))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per input row, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2 << 20):
            texts = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            fps = simhash_texts([t or b"" for t in texts], shingle_words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(fps)], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _cell(fp):
    """Population counts of the four 16-bit words as base-32 digits."""
    words = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    return sum((w.cast("long") * 32 ** i for i, w in enumerate(words)), F.lit(0).cast("long"))


def neighbour_steps(radius: int) -> list[int]:
    """Differences between cells whose counts differ by at most ``radius`` in
    sum, one of each opposite pair; the zero step first.  Counts run from 0 to
    16, so a step out of that range lands on a digit no cell has."""
    steps = {sum(d * 32 ** i for i, d in enumerate(ds))
             for ds in itertools.product(range(-radius, radius + 1), repeat=4)
             if sum(map(abs, ds)) <= radius}
    return sorted(s for s in steps if s >= 0)


def cut_tiles(fps: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(tile, cell, n, fps): distinct fingerprints packed into tiles of one
    cell each; a tile is named by its first fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cell, values):
            return {"tile": int(values[0]), "cell": int(cell), "n": len(values), "fps": values.tobytes()}

        cell, held, schema = None, np.zeros(0, dtype=np.int64), pa.schema(
            [("tile", pa.int64()), ("cell", pa.int64()), ("n", pa.int32()), ("fps", pa.binary())])
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False)
            rows = []
            edges = np.flatnonzero(np.diff(cells)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    if len(held):
                        rows.append(flush(cell, held))
                    cell, held = cells[lo], np.zeros(0, dtype=np.int64)
                held = np.concatenate([held, values[lo:hi]])
                while len(held) >= tile_rows:
                    rows.append(flush(cell, held[:tile_rows]))
                    held = held[tile_rows:]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if len(held):
            yield pa.RecordBatch.from_pylist([flush(cell, held)], schema)

    ordered = fps.select(_cell(F.col("fp")).alias("cell"), "fp").repartitionByRange("cell", "fp")
    return ordered.sortWithinPartitions("cell", "fp").mapInArrow(
        run, "tile long, cell long, n int, fps binary")


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles (or within one, if
    ``b`` is ``a``) as two arrays of fingerprints."""
    same = b is a
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(values))
    strip = max(1, STRIP_CELLS // max(1, len(b)))
    for lo in range(0, len(a), strip):
        near = np.bitwise_count(a[lo:lo + strip, None] ^ b[None, :]) <= radius
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(lo, min(lo + strip, len(a)))[:, None]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i, j = i + lo, j + shift
        while True:
            while not np.array_equal(label, label[label]):
                label = label[label]
            li, lj = label[i], label[j]
            if np.array_equal(li, lj):
                break
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def near_links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints that join the same ones as
    all pairs at ``radius`` or fewer differing bits would."""
    tiles = staged(cut_tiles(fps, tile_rows), "simhash-tiles")
    steps = F.array(*[F.lit(s).cast("long") for s in neighbour_steps(radius)])
    left = tiles.select(F.col("tile").alias("a"), F.col("cell").alias("cell_a"),
                        F.explode(steps).alias("step")).select(
        "a", "step", (F.col("cell_a") + F.col("step")).alias("cell"))
    pairs = left.join(tiles.select(F.col("tile").alias("b"), "cell"), "cell").where(
        "step > 0 OR a <= b").select("a", "b")
    pairs = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a")
    pairs = pairs.join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for x, y, same in zip(column_list(batch, "fa"), column_list(batch, "fb"),
                                  column_list(batch, "same")):
                a = np.frombuffer(x, dtype=np.uint64)
                b = a if same else np.frombuffer(y, dtype=np.uint64)
                u, v = tile_links(a, b, radius)
                if len(u):
                    us.append(u.view(np.int64))
                    vs.append(v.view(np.int64))
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return pairs.select((F.col("a") == F.col("b")).alias("same"), "fa", "fb").mapInArrow(
        run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row.

    Copies share one fingerprint and meet as one row in the tiles; the
    counting of copies is a partial aggregate, the way back a plain join.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle_words), "simhash-fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("min_id"))
    links = near_links(distinct.select("fp"), radius, tile_rows)
    comps = connected_components(links).withColumnRenamed("node", "fp")
    rooted = staged(distinct.join(comps, "fp", "left").select(
        "fp", "min_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
