"""Benchmark decontamination by latent semantic retrieval.

Texts are taken as overlapping passages of words. Words of the benchmark that are rare in the corpus span a
TF-IDF space; a randomised SVD of all passages there, its products summed task by task over a compact table
of the passages' words, gives the leading right singular directions and singular values. A text is looked at
for an item if it has one of the item's index words, so few that no text that could be confirmed lacks all
of them; passages of such texts are candidates by their cosine with the item in the latent space. A candidate
is confirmed if a longest common subsequence of words, in a window of the passage and its surroundings,
holds most of the item, and if the item's answer, its most telling words, is there too; where all of the
answer is there, the item's halves may stand in either order. Long items are retrieved by parts of nearly
equal length, and aligned as a whole with the surroundings of the parts that a text holds. Items of a few
words count as held where they stand word for word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_batches, materialize, read_table, slices, tune

#: A passage is SPAN blocks of STRIDE words, and begins at every block.
STRIDE, SPAN = 32, 3
#: Words in more than this share of texts aren't used for retrieval, but each item keeps its KEEP rarest.
COMMON, KEEP = 0.02, 8
#: Directions of the latent space, power steps to find them; those below LEAST of the largest singular value are dropped.
DIRECTIONS, POWERS, LEAST, SEED = 96, 1, 1e-6, 20
#: Least cosine of a candidate; least share of an item's words in order, and of its answer's words, to confirm one.
COSINE, IN_ORDER, ANSWER, ANSWER_WORDS = 0.25, 0.7, 0.6, 5
#: Items are compared in parts of so many words at most, so that a passage can hold a part.
PART = 64
#: Items of fewer words are searched word for word.
SHORT = 8
#: A part is looked for in windows of so many times its words, which begin at every half of them.
WINDOW = 2
#: Bytes of texts taken at once: a word of the vocabulary has a row of DIRECTIONS numbers there.
SLICE = 1 << 20
#: Characters of benchmark items that one search takes; a larger benchmark is searched for in blocks.
BLOCK = 8 << 20
SCHEMA = "doc_id long, item_id long, cosine double, in_order double, answer double"
# ASCII punctuation, and what takes its place.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words between white space and ASCII punctuation."""
    return text.lower().encode().translate(BLANKED).split() if text else []


class Items:
    """The benchmark: its items' words, the words that retrieval uses with their weights, and the index words."""

    def __init__(self, rows: list[tuple[int, str | None]], texts: int, frequency: dict[bytes, int]):
        self.items = [(k, w) for k, t in rows if (w := words_of(t))]
        idf = {w: math.log((1 + texts) / (1 + n)) + 1 for w, n in frequency.items()}
        rank = lambda w: (-idf[w], w)
        cuts = [(i, len(w), -(-len(w) // PART)) for i, (_, w) in enumerate(self.items)]
        spans = [(i, size * k // n, size * (k + 1) // n) for i, size, n in cuts for k in range(n)]
        self.parts = [(i, self.items[i][1][a:b]) for i, a, b in spans]
        #: A long item's answer has the most telling words of each of its parts.
        answers: list[set[bytes]] = [set() for _ in self.items]
        for i, words in self.parts:
            answers[i].update(sorted(set(words), key=rank)[:ANSWER_WORDS])
        self.answers = [sorted(a, key=rank) for a in answers]
        chosen = {w for w, n in frequency.items() if n <= COMMON * texts}.union(*answers)
        for _, words in self.items:
            chosen.update(sorted(set(words), key=rank)[:KEEP])
        self.vocabulary = {w: i for i, w in enumerate(sorted(chosen))}
        self.idf = np.array([idf[w] for w in self.vocabulary], np.float64)
        #: Words of the item before and after each part.
        self.beside = [(a, len(self.items[i][1]) - b) for i, a, b in spans]
        #: Each item's parts, from the first to before the last.
        first = np.searchsorted([i for i, *_ in spans], np.arange(len(self.items) + 1))
        self.parts_of = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        self.short = [len(w) < SHORT for _, w in self.items]
        self.kinds = [frozenset(w) for _, w in self.items]
        # Each word of an item that isn't there is one less in order.
        self.spare = [0 if s else math.floor((1 - IN_ORDER) * len(w) + 1e-9) for s, (_, w) in zip(self.short, self.items, strict=True)]
        many = defaultdict(int)
        for a in self.answers:
            for w in a:
                many[w] += 1
        # A text without any of these has less of the answer than it takes to confirm the item.
        postings: dict[int, list[int]] = defaultdict(list)
        for i, own in enumerate(self.answers):
            lack = 0 if self.short[i] else len(own) - math.ceil(ANSWER * len(own) - 1e-9)
            for w in sorted(own, key=lambda w: (frequency[w] * many[w], w))[: lack + 1]:
                postings[self.vocabulary[w]].append(i)
        sizes = np.array([len(postings[w]) if w in postings else 0 for w in range(len(self.vocabulary))], np.int64)
        self.post_size, self.post_start = sizes, np.cumsum(sizes) - sizes
        self.post_items = np.array([i for w in range(len(self.vocabulary)) if w in postings for i in postings[w]], np.int64)

    def vectors(self, parts: list[list[bytes]]) -> np.ndarray:
        out = np.zeros((len(parts), len(self.idf)))
        for row, words in zip(out, parts, strict=True):
            for w in words:
                if (i := self.vocabulary.get(w)) is not None:
                    row[i] += self.idf[i]
        return out

    def holders(self, owner: np.ndarray, word: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) of the texts that have an index word of the item, of all vocabulary words in texts."""
        has = np.flatnonzero(self.post_size[word])
        owner, word = owner[has], word[has]
        size = self.post_size[word]
        at = np.repeat(self.post_start[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs = np.unique(np.repeat(owner, size) * len(self.items) + self.post_items[at])
        return list(zip((pairs // len(self.items)).tolist(), (pairs % len(self.items)).tolist(), strict=True))


def blocks(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """(text, block, word) of each word of the vocabulary in the texts, in their order, and the texts' words."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split])
    found = np.fromiter(map(vocabulary.get, chain.from_iterable(split), repeat(-1)), np.int64, int(sizes.sum()))
    at = np.flatnonzero(found >= 0)
    owner = np.repeat(np.arange(len(split)), sizes)[at]
    place = at - (np.cumsum(sizes) - sizes)[owner]
    return owner, place // STRIDE, found[at], split


def passages(owner: np.ndarray, block: np.ndarray, word: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first block, words counted, sum of the words' rows of `weighted`) of each passage with a word of the vocabulary."""
    if not len(owner):
        return owner, block, word, np.zeros((0, weighted.shape[1]), weighted.dtype)
    wide = int(block.max()) + SPAN
    key = owner * wide + block + SPAN - 1  # the last passage that holds the block begins at it
    uniq, start = np.unique(key, return_index=True)
    count = np.diff(np.r_[start, len(key)])
    sums = np.add.reduceat(weighted[word], start, axis=0)
    starts = np.unique(np.concatenate([uniq - k for k in range(SPAN)]))
    starts = starts[starts % wide >= SPAN - 1] if SPAN > 1 else starts
    total, n = np.zeros((len(starts), weighted.shape[1]), weighted.dtype), np.zeros(len(starts), np.int64)
    for k in range(SPAN):
        i = np.minimum(np.searchsorted(uniq, starts + k), len(uniq) - 1)
        has = uniq[i] == starts + k
        total[has] += sums[i[has]]
        n[has] += count[i[has]]
    return starts // wide, starts % wide - (SPAN - 1), n, total


def in_order(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of one whole number."""
    place: dict[bytes, int] = {}
    for i, w in enumerate(item):
        place[w] = place.get(w, 0) | 1 << i
    row, full = (1 << len(item)) - 1, (1 << len(item)) - 1
    for w in words:
        if hit := place.get(w):
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def frequencies(docs: DataFrame, words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of texts, and of texts with each of the words: counted in tasks, then summed."""
    tune(docs.sparkSession)
    number = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(len(number), np.int64), 0
        known = number.keys()
        for batch in batches:
            texts += batch.num_rows
            for part in slices(batch, most=SLICE):
                for t in part.column(0).to_pylist():
                    for w in known & set(words_of(t)):
                        counts[number[w]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[texts, counts[at]])], names=["word", "n"])

    # At most one row for each word of the benchmark.
    rows = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found.pop(-1, 0), {w: found.get(i, 0) for w, i in number.items()}


def share_in_order(item: list[bytes], words: list[bytes], both_orders: bool = False) -> float:
    """The share of an item's words that stand in order in a window of the words, the best of all windows.

    With both_orders the item's halves may stand in either order: each is aligned by itself.
    """
    size, best = len(item), 0
    wide, step = WINDOW * size, max(size // 2, 1)
    for at in range(0, max(len(words) - wide, 0) + step, step):
        some = words[at : at + wide]
        best = max(best, in_order(item, some))
        if both_orders and best < size:
            best = max(best, in_order(item[: size // 2], some) + in_order(item[size // 2 :], some))
    return best / size


def vocabulary_hits(docs: DataFrame, items: Items) -> DataFrame:
    """The vocabulary's words in all texts, some texts to a row: their numbers there, blocks and words.

    Written: each product of the SVD reads this in place of the texts.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                owner, block, word, _ = blocks(part.column(0).to_pylist(), sent.value)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (owner, block, word)], names=["owner", "block", "word"])

    return materialize(docs.mapInArrow(run, "owner binary, block binary, word binary"), "passages")


def product(hits: DataFrame, items: Items, right: np.ndarray) -> np.ndarray:
    """(A'A) times `right`, with A the TF-IDF matrix of all passages and of the items' parts."""
    sent = hits.sparkSession.sparkContext.broadcast((len(items.idf), (right * items.idf[:, None]).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, weighted = sent.value
        total = np.zeros((size, weighted.shape[1]), np.float32)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owner, block, word = (np.frombuffer(x, np.int32).astype(np.int64) for x in row)
                who, first, _, sums = passages(owner, block, word, weighted)
                # Each word adds the sum of every passage that it is in.
                wide = int(block.max()) + SPAN
                key = who * wide + first + SPAN - 1
                own = np.zeros((len(word), weighted.shape[1]), np.float32)
                for k in range(SPAN):
                    want = owner * wide + block - k + SPAN - 1
                    i = np.minimum(np.searchsorted(key, want), len(key) - 1)
                    has = key[i] == want
                    own[has] += sums[i[has]]
                order = np.argsort(word, kind="stable")
                some, start = np.unique(word[order], return_index=True)
                total[some] += np.add.reduceat(own[order], start, axis=0)
        at = np.flatnonzero(total.any(1))
        for k in range(0, len(at), 1000):
            part = at[k : k + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x.tobytes() for x in total[part]], pa.binary())], names=["word", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(row, np.float32).astype(np.float64)
                sums[w] = sums[w] + x if w in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["word", "row"])

    out = np.zeros(right.shape)
    # A row for each word and task is added up by word; the driver gets one for each word of the vocabulary.
    for r in hits.mapInArrow(run, "word long, row binary").repartition("word").mapInArrow(add, "word long, row binary").toLocalIterator():
        out[r["word"]] = np.frombuffer(bytes(r["row"]))
    out *= items.idf[:, None]
    for at in range(0, len(items.parts), 1000):
        own = items.vectors([p for _, p in items.parts[at : at + 1000]])
        out += own.T @ (own @ right)
    return out


def singular_directions(docs: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and the singular values of the TF-IDF matrix A of all passages and items.

    Randomised SVD: an orthonormal basis Q of (A'A) R for a random R, taken once more through A'A for each
    power step; then the projected matrix (AQ)'(AQ), whose eigenvectors turn Q into singular vectors and
    whose eigenvalues are the squared singular values.
    """
    width = min(DIRECTIONS, len(items.idf))
    hits = vocabulary_hits(docs, items)
    basis = np.random.default_rng(SEED).standard_normal((len(items.idf), width))
    for _ in range(1 + POWERS):
        basis = np.linalg.qr(product(hits, items, basis))[0]
    projected = basis.T @ product(hits, items, basis)
    discard(hits)
    squared, turn = np.linalg.eigh((projected + projected.T) / 2)
    values = np.sqrt(np.maximum(squared[::-1], 0))
    keep = values > LEAST * values[0]
    return (basis @ turn[:, ::-1])[:, keep], values[keep]


class Finder:
    """What a task needs to find the items in texts."""

    def __init__(self, items: Items, weighted: np.ndarray, probes: np.ndarray):
        self.items, self.weighted, self.probes = items, weighted, probes

    def find(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(text number, item id, cosine, share in order, share of the answer) of each item that a text holds."""
        items = self.items
        owner, block, word, split = blocks(texts, items.vocabulary)
        pairs: dict[int, list[int]] = defaultdict(list)
        last, there = -1, frozenset()
        for text, item in items.holders(owner, word):
            if text != last:
                last, there = text, frozenset(split[text])
            if len(items.kinds[item] - there) <= items.spare[item]:
                pairs[text].append(item)
        if not pairs:
            return []
        # Passages of those texts only.
        wanted = np.zeros(len(split), bool)
        wanted[list(pairs)] = True
        some = wanted[owner]
        who, first, _, vectors = passages(owner[some], block[some], word[some], self.weighted)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        begin = np.searchsorted(who, np.arange(len(split) + 1))
        out = []
        for text, held in sorted(pairs.items()):
            own = slice(begin[text], begin[text + 1])
            starts = (first[own] * STRIDE).tolist()
            for item in held:
                a, b = items.parts_of[item]
                cosines = vectors[own] @ self.probes[a:b].T
                found = self.word_for_word if items.short[item] else self.aligned
                if (hit := found(item, split[text], starts, cosines)) is not None:
                    out.append((text, items.items[item][0], *hit))
        return out

    def word_for_word(self, item: int, words: list[bytes], starts: list[int], cosines: np.ndarray) -> tuple[float, float, float] | None:
        """(cosine, 1, 1) of the best passage if a short item stands in the words as it is."""
        want = self.items.items[item][1]
        rare = self.items.answers[item][0]
        before, at = want.index(rare), -1
        for _ in range(words.count(rare)):
            at = words.index(rare, at + 1)
            if at >= before and words[at - before : at - before + len(want)] == want:
                return float(cosines.max()), 1.0, 1.0
        return None

    def aligned(self, item: int, words: list[bytes], starts: list[int], cosines: np.ndarray) -> tuple[float, float, float] | None:
        """(cosine, share in order, share of the answer) of an item that the words hold, by the passages close to its parts."""
        items, own = self.items, self.items.answers[item]
        whole, (a, b) = items.items[item][1], items.parts_of[item]
        places, best = [], (0.0, 0.0, 0.0)
        for p, q in zip(*(x.tolist() for x in np.nonzero(cosines >= COSINE)), strict=True):
            start, end = max(starts[p] - PART, 0), starts[p] + SPAN * STRIDE + PART
            some, part = words[start:end], items.parts[a + q][1]
            there = frozenset(some)
            if len(frozenset(part) - there) > (1 - IN_ORDER) * len(part) + 1e-9:
                continue
            answer = sum(w in there for w in own) / len(own)
            share = share_in_order(part, some, both_orders=b - a == 1 and answer == 1.0)
            if share < IN_ORDER:
                continue
            if b - a > 1:
                before, after = items.beside[a + q]
                places.append((max(start - before, 0), end + after, float(cosines[p, q])))
            elif answer >= ANSWER:
                best = max(best, (share, answer, float(cosines[p, q])))
                if share == answer == 1.0:
                    break
        if places:
            # All surroundings of the item's parts, in the text's order and each word once.
            some, last = [], 0
            for start, end, _ in sorted(places):
                some += words[max(start, last) : end]
                last = max(last, end)
            there = frozenset(some)
            share, answer = in_order(whole, some) / len(whole), sum(w in there for w in own) / len(own)
            if share >= IN_ORDER and answer >= ANSWER:
                best = share, answer, max(c for *_, c in places)
        return (best[2], best[0], best[1]) if best[0] else None


def prepare(docs: DataFrame, benchmark: DataFrame) -> Finder | None:
    """Statistics and directions of all texts (text) for one block of items (item_id, text), which is collected."""
    rows = [(r[0], r[1]) for r in benchmark.collect()]
    words = sorted({w for _, t in rows for w in words_of(t)})
    if not words:
        return None
    items = Items(rows, *frequencies(docs, words))
    directions, _ = singular_directions(docs, items)
    probes = np.concatenate([items.vectors([p for _, p in items.parts[at : at + 1000]]) @ directions for at in range(0, len(items.parts), 1000)])
    probes /= np.maximum(np.linalg.norm(probes, axis=1, keepdims=True), 1e-12)
    return Finder(items, (directions * items.idf[:, None]).astype(np.float32), probes.astype(np.float32))


def finders(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Iterator[Finder]:
    """A finder for each block of the benchmark: what the driver and a broadcast hold is bounded by BLOCK."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text").cast("long")).alias("n")).collect()[0]["n"] or 0
    count = -(-size // BLOCK)
    for k in range(count):
        finder = prepare(texts, items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k))
        if finder is not None:
            yield finder


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each text and benchmark item that it holds: doc_id, item_id, cosine, in_order and answer.

    Null and empty texts and items hold and are held by nothing; items without words are passed over.
    Null ids stay, repeated rows are all reported; other columns are not read. No rows, or no items: no
    rows out.
    """
    spark = docs.sparkSession
    read, out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), None
    for finder in finders(docs, benchmark, text_col, item_col, item_text_col):
        found = map_batches(read, SCHEMA, lambda sent=spark.sparkContext.broadcast(finder): _rows(sent), most=SLICE)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _rows(sent):
    def run(batch):
        ids, found = batch.column(0).to_pylist(), sent.value.find(batch.column(1).to_pylist())
        text, item, *rest = zip(*found, strict=True) if found else ((),) * 5
        return {"doc_id": [ids[t] for t in text], "item_id": list(item), **{k: list(v) for k, v in zip(("cosine", "in_order", "answer"), rest, strict=True)}}

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all of their columns; decided row by row, without a join.

    Null and empty texts hold nothing and stay, repeated rows are judged alike.
    """
    for finder in finders(docs, benchmark, text_col, "item_id", "text"):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(finder))(F.col(text_col)))
    return docs


def _clean(sent):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out, at = np.ones(len(s), bool), 0
            for part in slices(pa.RecordBatch.from_arrays([pa.array(s, pa.string())], names=["text"]), most=SLICE):
                for t, *_ in sent.value.find(part.column(0).to_pylist()):
                    out[at + t] = False
                at += part.num_rows
            yield pd.Series(out)

    return clean


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over documents and benchmark: a row for each document and item that it holds."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
