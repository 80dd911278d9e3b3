"""Cross-tokenizer alignment against plain loops and the plain libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from medallion.llm import cross_tokenizer as X

from tests.llm.conftest import EDGE_ROWS, by_key, prose, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(20, "a<|endoftext|>b <s> </s> <unk>"), (21, "▁ is a piece mark"), (22, " begins and ends with a space "),
       (23, "tabs\tand\r\nlines"), (24, "\x00\x01 control \x7f"), (25, "é ﬁ ½ Ⅷ"), (26, "日本語のテキスト"),
       (27, "👩‍👩‍👧‍👦 family"), (28, "===== ----- ....."), (29, "   "), (30, "same words same words")]
ROWS = [*EDGE_ROWS, *ODD]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(libraries, text):
    """[(id, bytes)] of A and of B by the libraries themselves."""
    a, b = libraries
    if not text:
        return [], []
    whole, left = (" " + text).encode(), []
    of = X.byte_characters()
    for i in a.encode(" " + text, add_special_tokens=False).ids:
        left.append((i, bytes(of[c] for c in a.id_to_token(i))))
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
              b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    both = [b"".join(t for _, t in side) for side in (left, right)]
    return (left, right) if both == [whole, whole] else ([], [])


def ends(tokens):
    out, at = [], 0
    for _, t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain_scores(libraries, rows):
    docs, count = [], Counter()
    for doc, text in rows:
        left, right = plain_tokens(libraries, text)
        a, b = ends(left), ends(right)
        at = {e: i for i, e in enumerate(a)}
        links = [(left[at[e]][0], right[j][0]) for j, e in enumerate(b) if e in at]
        count.update(links)
        groups, prev = [], 0
        for e in sorted(set(a) & set(b)):
            groups.append(",".join(str(t[0]) for t, x in zip(left, a) if prev < x <= e) + "|" +
                          ",".join(str(t[0]) for t, x in zip(right, b) if prev < x <= e))
            prev = e
        text = ";".join(groups)
        docs.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(doc, n_a, n_b, n, len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), sha)
            for doc, n_a, n_b, n, links, sha in docs]


def table(spark, edge_docs, rows):
    extra = [c for c in edge_docs.columns if c not in ("doc_id", "text")]
    return spark.createDataFrame([(i, t, *["?"] * len(extra)) for i, t in rows],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra)).repartition(3)


@pytest.mark.parametrize("slice_bytes,block_pairs", [(1 << 20, 1 << 21), (50, 7)])
def test_scores(spark, edge_docs, libraries, slice_bytes, block_pairs):
    rows = [(i, t if t is None else t[:1500]) for i, t in ROWS]
    if block_pairs < 10:
        rows = [(i, t if t is None else t[:60]) for i, t in rows][::3]
    found = X.link_scores(table(spark, edge_docs, rows), A, B, slice_bytes=slice_bytes, block_pairs=block_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_key(rows_of(found)) == by_key(plain_scores(libraries, rows))


def test_empty_table(spark, no_docs):
    assert rows_of(X.link_scores(no_docs, A, B)) == [] == rows_of(X.align(no_docs, A, B))


def test_align_and_group_links(spark, edge_docs, libraries):
    rows = [(i, t[:300]) for i, t in enumerate(t for _, t in ROWS if t)]
    aligned = X.align(table(spark, edge_docs, rows), A, B)
    shared = {}
    for r in X.group_links(aligned).collect():
        shared.setdefault(r["doc_id"], set()).add((r["group"], r["a"], r["b"]))
    for r in aligned.collect():
        left, right = plain_tokens(libraries, rows[r["doc_id"]][1])
        a, b = ends(left), ends(right)
        assert ([i for i, _ in left], a, [i for i, _ in right], b) == (r["a_ids"], r["a_ends"], r["b_ids"], r["b_ends"])
        cuts = sorted(set(a) & set(b))
        assert r["group_ends"] == cuts
        spans = [[(e - len(t), e) for (_, t), e in zip(side, own)] for side, own in ((left, a), (right, b))]
        assert set(zip(r["overlap_a"], r["overlap_b"], r["overlap_bytes"])) == {
            (i, j, min(e, f) - max(s, t)) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1])
            if min(e, f) > max(s, t)}
        group = [[sum(c < e for c in cuts) for e in own] for own in (a, b)]
        assert shared.get(r["doc_id"], set()) == {(g, i, j) for i, g in enumerate(group[0])
                                                  for j, h in enumerate(group[1]) if g == h}


@pytest.mark.parametrize("terms", [1, 5, 1000])
def test_products_of_any_matrices(terms):
    rng = np.random.default_rng(terms)
    for rows, width, other in ((0, 3, 4), (7, 5, 6), (20, 9, 1), (1, 0, 3)):
        a, b = rng.random((rows, width)) < 0.4, rng.random((other, width)) < 0.4
        found = np.zeros((rows, other), dtype=int)

        def csr(m):
            return X.Csr(np.append(0, np.cumsum(m.sum(axis=1))).astype(int), np.nonzero(m)[1], m.shape[1])
        for i, j, n in X.products(csr(a), csr(b).transposed(), terms):
            found[i, j] += n
        assert (found == a.astype(int) @ b.T.astype(int)).all()


def test_long_text_in_parts(libraries, monkeypatch):
    """Cut between words, the libraries give the ids of the whole text; so do
    strips of the digest."""
    rng = random.Random(4)
    text = " ".join(rng.choice([prose(i, 3), "3.14, then.", "naïve  two", "\n", "e.g. x", "漢 字"]) for i in range(9000))
    both = X.load(open(A, "rb").read(), open(B, "rb").read())
    assert both.cuts
    monkeypatch.setattr(X, "PART_CHARS", 300)
    assert len(both.parts(text)) > 100
    own = X.Slice(both, [text, "", "one", text[:500]])
    whole = [i for i, _ in plain_tokens(libraries, text)[0]], [i for i, _ in plain_tokens(libraries, text)[1]]
    assert own.a[:own.n_a[0]].tolist() == whole[0] and own.b[:own.n_b[0]].tolist() == whole[1]
    digests = own.group_digests()
    monkeypatch.setattr(X, "STRIP_TERMS", 1001)
    assert own.group_digests() == digests and digests[1] == ""


def test_text_of_megabytes():
    """Work grows with the text: 12 MB in one row."""
    both = X.load(open(A, "rb").read(), open(B, "rb").read())
    text = prose(5, 120_000) + " "
    own = X.Slice(both, [text * 10])
    a, b = own.alignment.links()
    assert len(text) * 10 > 10_000_000 and own.bytes[0] == len(text) * 10 + 1 == own.alignment.cuts[-1]
    assert len(a) == len(own.alignment.cuts) and len(own.group_digests()[0]) == 64
