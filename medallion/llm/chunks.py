"""Cached encoding of texts cut between words.

The word pattern of byte-level BPE never lets a match run across the place
before a space that is followed by a visible character: letters, digits and
other marks take at most one space, in front, and a run of white space
leaves its last space to what follows.  Texts can therefore be cut there,
each chunk (its space included) encoded by itself, and equal chunks encoded
once.  A comma or full stop between a letter or digit and such a space is a
match of its own and becomes a chunk, so that a word is one chunk with it and
without.  So does a line break between two visible characters, and the chunk
after it has no space in front.  A text with a chunk that is empty or begins
with white space (two spaces in a row, a space before a line break) is
encoded whole instead, and so is one with such a mark after anything but a
letter or digit, or a line break after white space.

Arrow cuts the texts of a slice and numbers their distinct chunks; only
these are looked up.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged_gather

MAX_CACHED = 250_000        # chunks that a process keeps
MAX_CHARS = 1 << 23         # and their characters

#: Control characters that stand for a comma, a full stop and a line break
#: that are chunks, and for the want of a space in front of a chunk; a text
#: that holds one of them is encoded whole.
COMMA, STOP, BREAK, BARE = "\x02", "\x03", "\x05", "\x04"
MARKS = {COMMA: ",", STOP: ".", BREAK: "\n"}
HELD_BACK = f"[{COMMA}{STOP}{BREAK}{BARE}]"


class ChunkEncoder:
    """``encode_parts`` maps strings to id arrays; it must treat each string
    as a text of its own.  Of the chunks seen the more frequent ones stay, up
    to half of either bound, when there are more than ``max_cached`` or they
    have more than ``max_chars`` characters."""

    def __init__(self, encode_parts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 max_cached: int = MAX_CACHED, max_chars: int = MAX_CHARS):
        self.encode_parts = encode_parts
        self.max_cached, self.max_chars = max_cached, max_chars
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts, self.lengths, self.hits, self.sizes = (np.zeros(0, dtype=np.int64) for _ in range(4))
        # begins wrongly; ends in a letter or digit; in a visible character;
        # is a comma or stop; is a line break
        self.flags = np.zeros((0, 5), dtype=bool)

    def _trim(self) -> None:
        keep = np.argsort(-self.hits, kind="stable")[:self.max_cached // 2]
        keep = np.sort(keep[np.cumsum(self.sizes[keep]) <= self.max_chars // 2])
        chunks = list(self.numbers)
        self.numbers = {chunks[i]: n for n, i in enumerate(keep.tolist())}
        self.ids = ragged_gather(self.ids, self.starts[keep], self.lengths[keep])
        self.lengths, self.hits, self.sizes = self.lengths[keep], self.hits[keep] // 2, self.sizes[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flags = self.flags[keep]

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        strings, flags = [], np.zeros((len(new), 5), dtype=bool)
        for chunk, flag in zip(new, flags):
            body = chunk[1:] if chunk[:1] == BARE else chunk
            odd = not body or body[0].isspace()
            strings.append("" if odd else MARKS[chunk] if chunk in MARKS else body if body is not chunk else " " + chunk)
            flag[:] = odd, body[-1:].isalnum(), not body[-1:].isspace(), chunk in (COMMA, STOP), chunk == BREAK
        ids, lengths = self.encode_parts(strings)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.flags = np.concatenate([self.flags, flags])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), dtype=np.int64, count=len(new))])

    def _chunks(self, texts: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of every chunk, chunks per text, texts to encode whole)."""
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, HELD_BACK).to_numpy(zero_copy_only=False).copy()
        column = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), column)
        for text, mark in ((", ", f" {COMMA} "), (". ", f" {STOP} "), ("\n", f" {BREAK} {BARE}")):
            column = pc.replace_substring(column, text, mark)
        if not spaced:
            column = pc.binary_join_element_wise(pa.scalar(BARE, pa.large_string()), column,
                                                 pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(column, " ")
        coded = lists.flatten().dictionary_encode()
        chunks, numbers = coded.dictionary.to_pylist(), self.numbers
        new = [c for c in chunks if c not in numbers]
        for c in new:
            numbers[c] = len(numbers)
        self._learn(new)
        own = np.fromiter(map(numbers.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        return own[coded.indices.to_numpy()], lists.value_lengths().to_numpy().astype(np.int64), whole

    def encode(self, texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids per text) of the texts, or with
        ``spaced`` of a space and each; an empty text has no ids."""
        if len(self.numbers) > self.max_cached or self.sizes.sum() > self.max_chars:
            self._trim()
        if not texts:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        flat, counts, whole = self._chunks(texts, spaced)
        # a text without characters is one bare chunk of nothing: no ids
        empty = np.fromiter((not t for t in texts), dtype=bool, count=len(texts)) & ~whole
        self.hits += np.bincount(flat, minlength=len(self.hits))
        owner = np.repeat(np.arange(len(texts)), counts)
        odd, solid, visible, mark, line = self.flags.T
        whole[owner[odd[flat]]] = True
        # the first chunk is never a mark, so the chunk before one is of the same text
        at = np.flatnonzero(mark[flat])
        whole[owner[at[~solid[flat[at - 1]]]]] = True
        at = np.flatnonzero(line[flat])
        whole[owner[at[~visible[flat[at - 1]]]]] = True
        whole[empty] = False
        stays = ~whole[owner] & ~empty[owner]
        flat, owner = flat[stays], owner[stays]
        sizes = self.lengths[flat]
        ids = ragged_gather(self.ids, self.starts[flat], sizes)
        n_ids = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        if not whole.any():
            return ids, n_ids
        rest, rest_sizes = self.encode_parts([" " * spaced + texts[i] for i in np.flatnonzero(whole)])
        pieces = np.split(ids, np.cumsum(n_ids[~whole])[:-1]) if (~whole).any() else []
        other = np.split(rest, np.cumsum(rest_sizes)[:-1])
        n_ids[whole] = rest_sizes
        left, right = iter(pieces), iter(other)
        return np.concatenate([next(right) if w else next(left) for w in whole]).astype(np.int32), n_ids


def text_blocks(strings: list[str], max_chars: int = 1 << 14) -> list[str]:
    """Strings joined to longer texts, in order; a new text begins wherever
    the next string does not begin with a space and a visible character."""
    blocks, held, size = [], [], 0
    for s in strings:
        if held and (size >= max_chars or s[:1] != " " or len(s) < 2 or s[1].isspace()):
            blocks.append("".join(held))
            held, size = [], 0
        held.append(s)
        size += len(s)
    return [*blocks, "".join(held)]


def flatten(arrays: list) -> tuple[np.ndarray, np.ndarray]:
    """A list of id lists as one row of ids and the lengths."""
    lengths = np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))
    return np.fromiter(itertools.chain.from_iterable(arrays), dtype=np.int32,
                       count=int(lengths.sum())), lengths


class LibraryEncoder:
    """The tokenizers library with a cache of chunks.  Texts that hold one of
    its added tokens, which it cuts out before anything else, are handed to
    it whole; without ``special_tokens`` their strings are plain text."""

    def __init__(self, vocabulary: bytes, max_cached: int = MAX_CACHED, max_chars: int = MAX_CHARS,
                 special_tokens: bool = True):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.encode_special_tokens = not special_tokens
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        # byte-level tokens are written with one character to a byte
        self.sizes = np.zeros(max(names.values(), default=0) + 1, dtype=np.int64)
        self.sizes[list(names.values())] = [len(n) for n in names]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = ChunkEncoder(self.parts, max_cached, max_chars)

    def parts(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Strings that may follow one another without changing each other's
        tokens are encoded as one text, and its ids dealt out by the bytes
        that they stand for."""
        blocks = text_blocks(strings)
        ids, _ = flatten([e.ids for e in self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False)])
        ends = np.cumsum(np.fromiter((len(s.encode()) for s in strings), dtype=np.int64, count=len(strings)))
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")
        return ids, np.diff(cuts, prepend=0)

    def encode(self, texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """As ``ChunkEncoder.encode``."""
        held = np.fromiter((any(a in t for a in self.added) for t in texts), dtype=bool, count=len(texts))
        ids, lengths = self.chunks.encode(["" if h else t for h, t in zip(held, texts)], spaced)
        if not held.any():
            return ids, lengths
        out = np.split(ids, np.cumsum(lengths)[:-1])
        for i in np.flatnonzero(held):
            out[i] = np.array(self.tokenizer.encode(" " * spaced + texts[i], add_special_tokens=False).ids, dtype=np.int32)
            lengths[i] = len(out[i])
        return np.concatenate(out), lengths
