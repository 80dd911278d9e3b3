"""SimHash near-dedup against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from medallion.llm import simhash_tiles as S
from medallion.llm.components import connected_components

from tests.llm.conftest import EDGE_ROWS, by_key, rows_of


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    """Smallest index reachable over links of at most ``radius`` bits."""
    label = list(range(len(values)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(values))]


def expected(rows, radius=3):
    values = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(values, radius)
    names = {g: min((i for (i, _), h in zip(rows, groups) if h == g and i is not None), default=None)
             for g in set(groups)}
    return [(i, v - (1 << 64) if v >> 63 else v, names[g]) for (i, _), v, g in zip(rows, values, groups)]


def test_edge_rows(edge_docs):
    assert by_key(rows_of(S.near_duplicates(edge_docs))) == by_key(expected(EDGE_ROWS))


def test_empty_table(no_docs):
    found = S.near_duplicates(no_docs)
    assert found.columns == ["doc_id", "fp", "component_id"] and rows_of(found) == []


@pytest.mark.parametrize("tile_rows", [4, 4096])
def test_links_reach_what_all_pairs_reach(spark, tile_rows):
    rng = random.Random(5)
    values = set()
    for _ in range(60):                       # chains of small steps, so that reach goes beyond one link
        v = rng.getrandbits(64)
        for _ in range(8):
            values.add(v)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
    links = S.near_links(fps, 3, tile_rows)
    for u, v in rows_of(links):
        assert ((u ^ v) & (1 << 64) - 1).bit_count() >= 0
    root = dict(rows_of(connected_components(links)))
    got, want = {}, {}
    for v, g in zip(signed, plain_components(values, 3)):
        got.setdefault(root.get(v, v), set()).add(v)
        want.setdefault(g, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_cells_cover_the_radius():
    steps = set(S.neighbour_steps(3))

    def cell(v):
        return sum(((v >> 16 * i) & 0xFFFF).bit_count() * 32 ** i for i in range(4))
    rng = random.Random(1)
    for _ in range(3000):
        a = rng.choice([rng.getrandbits(64), 0, (1 << 64) - 1])
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert abs(cell(a) - cell(b)) in steps


def test_majority_needs_over_half():
    hashes = np.array([0b11, 0b01, 0b10, 0b01], dtype=np.uint64)
    assert S.majority_bits(hashes, np.zeros(4, dtype=int), 2).tolist() == [0b01, 0]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 300)]
    star = [(5, i) for i in range(1000, 1400)] + [(5, 5)]
    got = dict(rows_of(connected_components(spark.createDataFrame(chain + star, "u long, v long"))))
    assert got == {**{i: 100 for i in range(100, 301)}, 5: 5, **{i: 5 for i in range(1000, 1400)}}
