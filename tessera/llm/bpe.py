"""Byte-level BPE encoding and decoding over a segment tree.

The leaves of a tree are the byte positions of one piece of text; a leaf holds the rank of the pair that
begins there, and a node the leftmost minimum below it. A merge takes the root, writes the three leaves
whose pairs changed (the merged token, its live left neighbour, the swallowed right one) and repairs their
paths: a logarithmic number of nodes. Short pieces are encoded many at a time, one tree a row of a numpy
array; long ones have a tree of their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, read_table

#: Pieces that a worker remembers, twice at most; what wasn't used since the last time is then forgotten.
PIECES = 300_000
#: A space beside white space: texts without it can be cut before each space, and no piece is cut in two.
UNEVEN = re.compile(r" \s|[^\S ] ")
#: Pieces of more bytes get a tree of their own.
LONG = 256
NONE = 1 << 60
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


class BytePairs:
    """Encoder and decoder of one vocabulary: token bytes by rank, and the expression that splits a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks, self.token = ranks, {v: k for k, v in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {ranks[t[:i]] * self.size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.memory = Memory(self.find, self.encode_pieces)

    @classmethod
    @cache
    def from_tiktoken(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_alike(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """The ids of pieces of 2 to `leaves` bytes (a power of two), a tree to a row."""
        n, width = len(pieces), leaves
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        live = np.arange(width) < size[:, None]
        # A column more at the end: what stands after the last token. Positions count from 0, `width` is none.
        token = np.zeros((n, width + 1), np.int64)
        token[:, :width] = self.byte_ids[raw]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[after >= size[:, None]] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.rank_of(token[:, : width - 1], token[:, 1:width])
        rank[~live[:, 1:]] = NONE
        tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + np.arange(width - 1), NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(row, pos, value):
            node = pos + width
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            at, new = best % width, best // width
            gone = after[row, at]
            then = after[row, gone]
            token[row, at] = new
            live[row, gone] = False
            after[row, at] = then
            has = then < width
            before[row[has], then[has]] = at[has]
            put(row, gone, NONE)
            r = np.where(has, self.rank_of(new, token[row, then]), NONE)
            put(row, at, np.where(r < NONE, r * width + at, NONE))
            prev = before[row, at]
            if (has := prev >= 0).any():
                some, p = row[has], prev[has]
                r = self.rank_of(token[some, p], new[has])
                put(some, p, np.where(r < NONE, r * width + p, NONE))
            row = row[tree[row, 1] < NONE]
        ids = token[:, :width][live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live.sum(1))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, piece: bytes) -> bytes:
        """The ids of one piece of any length."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        pairs, size = self.pairs, self.size
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.rank_of(np.array(token[:-1]), np.array(token[1:]))
        leaves = np.full(width, NONE)
        leaves[: n - 1] = np.where(first < NONE, first * width + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(1))
        tree = [NONE, *(x for level in reversed(levels) for x in level.tolist())]

        def put(pos, value):
            node = pos + width
            tree[node] = value
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                if tree[node] == (a := a if a < b else b):
                    break
                tree[node] = a

        while (best := tree[1]) < NONE:
            at, new = best % width, best // width
            gone = after[at]
            then = after[gone]
            token[at], token[gone], after[at] = new, -1, then
            put(gone, NONE)
            rank = NONE
            if then >= 0:
                before[then] = at
                rank = pairs.get(new * size + token[then], NONE)
            put(at, rank * width + at if rank < NONE else NONE)
            if (prev := before[at]) >= 0:
                rank = pairs.get(token[prev] * size + new, NONE)
                put(prev, rank * width + prev if rank < NONE else NONE)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces as little-endian unsigned 32-bit integers."""
        out, alike = {}, {}
        for piece in pieces:
            raw = piece.encode()
            if (r := self.ranks.get(raw)) is not None:
                out[piece] = r.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[piece] = self.encode_long(raw)
            else:
                alike.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for leaves, some in alike.items():
            step = max(1, 400_000 // leaves)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                out.update(zip((p for p, _ in part), self.encode_alike([r for _, r in part], leaves), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        return self.memory.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Recent:
    """Ids by piece, in two generations: a full younger one becomes the older, whose pieces come back when used."""

    def __init__(self, most: int, encode: Callable[[list[str]], list[bytes]]):
        self.most, self.encode = most, encode
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, pieces: set[str] | list[str]) -> dict[str, bytes]:
        """The ids of all the pieces, none of them given twice; what isn't remembered is encoded."""
        own = dict(zip(pieces, map(self.young.get, pieces), strict=True))
        new = {p: self.old.get(p) for p, v in own.items() if v is None}
        lack = [p for p, v in new.items() if v is None]
        if new:
            new.update(zip(lack, self.encode(lack), strict=True))
            if len(self.young) + len(new) > self.most:
                self.old, self.young = self.young, new
            else:
                self.young.update(new)
            own.update(new)
        return own


    def of_list(self, pieces: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The same in the order of the pieces, what isn't remembered by this encoder."""
        out = list(map(self.young.get, pieces))
        miss = [k for k, v in enumerate(out) if v is None]
        if miss:
            names = list(map(pieces.__getitem__, miss))
            found = list(map(self.old.get, names))
            lack = [k for k, v in enumerate(found) if v is None]
            for k, v in zip(lack, encode(list(map(names.__getitem__, lack))), strict=True):
                found[k] = v
            new = dict(zip(names, found, strict=True))
            if len(self.young) + len(new) > self.most:
                self.old, self.young = self.young, new
            else:
                self.young.update(new)
            for k, v in zip(miss, found, strict=True):
                out[k] = v
        return out


class Memory:
    """Encodes texts whose splitter is `find`, each distinct piece once and each distinct word once.

    Pieces hold at most one space, as their first character, unless white space stands beside it; other
    texts are cut into words before each space, a word's ids being those of its pieces in turn.
    encode_words(), if given, takes words without the space before them. With no words to be remembered
    texts are split into pieces straight away, which pays where a piece costs more than a split.
    """

    def __init__(self, find: Callable, encode: Callable[[list[str]], dict[str, bytes]], encode_words: Callable | None = None, words: int = 0, pieces: int = PIECES):
        self.find = find
        self.pieces = Recent(pieces, lambda lack: list(map(encode(lack).__getitem__, lack)))
        self.words = Recent(words, encode_words or (lambda lack: self.split_and_encode([" " + w for w in lack])))

    def split_and_encode(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.find, texts))
        own = self.pieces.of(set().union(*split))
        return [b"".join(map(own.__getitem__, pieces)) for pieces in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.words.most:
            return self.split_and_encode([t or "" for t in texts])
        whole, cut = [], []
        for t in texts:
            if t and even(t):
                first, *rest = t.split(" ")
                whole.append(first)
                cut.append(rest)
            else:
                whole.append(t or "")
                cut.append(())
        own = self.words.of(set().union(*cut))
        return [a + b"".join(map(own.__getitem__, b)) for a, b in zip(self.split_and_encode(whole), cut, strict=True)]


def even(text: str) -> bool:
    """Whether no white space stands beside a space."""
    if text.isascii() and not any(c in text for c in "\t\r\x0b\x0c"):
        return "  " not in text and " \n" not in text and "\n " not in text
    return not UNEVEN.search(text)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded bytes.

    Null and empty texts: no ids, empty bytes. Null ids and repeated rows stay; columns other than the two
    named are not read. Decoding gives the text's UTF-8 bytes back. No rows in: no rows out.
    """
    path, split = default_vocabulary()
    path, split = vocabulary or path, pattern or split

    def make():
        coder = BytePairs.from_tiktoken(path, split)

        def run(batch):
            ids = coder.encode(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [coder.decode(x) for x in ids]}

        return run

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), SCHEMA, make)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over documents: one row a document, whole texts; null and empty texts have no ids."""
    return digests(encode_decode(read_table(spark, sf_dir, "documents")))
