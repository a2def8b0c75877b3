"""Removal of byte strings that occur elsewhere, by prefix-free parsing.

The corpus is dealt out by content first. A rolling hash over GRAM bytes sets triggers: of the grams that lie
in a string of LENGTH bytes, the one with the least hash, leftmost on ties, is the string's trigger. Every
string has one, and it depends on nothing but the string, so that all places of a string meet under it. All
strings of a text with one trigger start next to each other; together they cover one passage. A trigger that
occurs once rules out repetition for its whole passage, and passages that occur more than once as they are
need no comparison; the rest are the dictionary's.

In a task the passages that are left are a small corpus that says much the same again and again. There
prefix-free parsing sorts it: windows of WINDOW bytes whose rolling hash is 0 modulo MODULUS end its phrases,
which overlap by a window. A suffix array of the dictionary of distinct phrases and one of the parse combine
into the order of all the corpus's strings, and common prefixes of neighbours in that order tell which strings
of LENGTH bytes occur again.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_batches, materialize, read_table, trim
from tessera.llm.hashing import BASE, digests, mix

LENGTH, GRAM = 200, 64
#: Bytes of a trigger window between phrases, and the mean distance of such windows.
WINDOW, MODULUS = 12, 24
#: Bytes of texts that a worker takes at once.
SLICE = 2 << 20
#: Bytes parsed at once. Positions have 24 bits next to 40 bits of hash in the window minimum.
PART = 1 << 18
#: Different passages from which on a trigger's group is dealt out over all tasks, string by string, by their digests.
HOT = 2000
#: Bytes of passages that are sorted at once; the passages of one trigger stay together.
DICTIONARY = 1 << 19
PARSE_SCHEMA = "trigger long, p1 long, p2 long, k1 long, k2 long, place long, doc_id long"
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n, b)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of the data."""
    power, back = powers(1 << len(data).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[gram:] - total[:-gram]) * back[: len(data) - gram + 1])


def parse(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, trigger, two digests, lo, hi) of each passage: its strings start at the bytes lo to hi of its text."""
    rows: list[tuple[np.ndarray, ...]] = []
    group, size = [], 0
    jobs: list[list[tuple[int, int, bytes]]] = []
    for k, raw in enumerate(raws):
        # Strings start before `end`; a long text is taken in parts that overlap by what its last string needs.
        for start in range(0, max(len(raw) - length + 1, 0), PART):
            part = raw[start : start + PART + length - 1]
            if size + len(part) > 2 * PART and group:
                jobs.append(group)
                group, size = [], 0
            group.append((k, start, part))
            size += len(part)
    if group:
        jobs.append(group)
    n_grams = length - gram + 1
    for job in jobs:
        data = np.frombuffer(b"".join(p for *_, p in job), np.uint8)
        sizes = np.array([len(p) for *_, p in job])
        first = np.cumsum(sizes) - sizes
        grams = rolling(data, gram)
        least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        wide = 1
        while 2 * wide <= n_grams:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < n_grams:
            least = np.minimum(least[: len(least) - (n_grams - wide)], least[n_grams - wide :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(job)), counts)
        x = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
        t = at[x]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[new[1:] - 1, len(x) - 1]
        lo, hi, who = x[new], x[last], owner[new]
        offset = np.array([s for _, s, _ in job])[who] - first[who]
        rows.append((np.array([k for k, *_ in job])[who], grams[t[new]].view(np.int64), *digests(data, lo, hi + length), lo + offset, hi + offset))
    if not rows:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def text_keys(raws: list[bytes]) -> np.ndarray:
    """A 128-bit digest of each text, as two whole numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=16).digest() for r in raws), "<i8").reshape(-1, 2)


#: A passage's place is its first string's byte, and in so many bits how many strings follow it.
SPAN_BITS = 20


def parsed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The passages of all texts, a row for each, with their place in the text."""

    def make():
        def run(batch):
            raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
            who, trigger, p1, p2, lo, hi = parse(raws, length, gram)
            keys = text_keys(raws)[who]
            return {
                "trigger": pa.array(trigger),
                "p1": pa.array(p1),
                "p2": pa.array(p2),
                "k1": pa.array(keys[:, 0]),
                "k2": pa.array(keys[:, 1]),
                "place": pa.array(lo << SPAN_BITS | hi - lo),
                "doc_id": batch.column(0).take(pa.array(who)),
            }

        return run

    return map_batches(docs, PARSE_SCHEMA, make, most=SLICE)


def classes(x: np.ndarray) -> np.ndarray:
    """The rank of each number among the distinct ones."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def doubled(rank: np.ndarray, end: np.ndarray, have: int, depth: int) -> list[np.ndarray]:
    """Ranks of suffixes by prefix doubling, from `have` symbols on to `depth`: one array for each depth.

    A suffix ends before the position `end`; what ended is less than what goes on.
    """
    out, n = [rank], len(rank)
    at = np.arange(n)
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)
        on = np.flatnonzero(at + step < end)
        after[on] = rank[on + step] + 1
        rank = classes(rank * (n + 1) + after)
        out.append(rank)
        have += step
    return out


def suffix_ranks(data: bytes, depth: int, end: np.ndarray | None = None) -> np.ndarray:
    """Rank of each position's string of `depth` bytes in lexicographic order, equal for equal strings.

    The suffix array's order to that depth, by prefix doubling from seven bytes on. Strings end at the
    data's end, or before the position `end`; an end is less than any byte.
    """
    n = len(data)
    end = np.full(n, n) if end is None else end
    raw = np.zeros(n + 7, np.int64)
    raw[:n] = np.frombuffer(data, np.uint8)
    rank, at = np.zeros(n, np.int64), np.arange(n)
    for k in range(min(7, depth)):
        rank = rank << 9 | np.where(at + k < end, raw[k : n + k] + 1, 0)
    return doubled(classes(rank), end, 7, depth)[-1]


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo + 1 : hi + 1] for each pair lo < hi, by a sparse table."""
    table, wide = [values], 1
    most = int((hi - lo).max(initial=1))
    while 2 * wide <= most:
        table.append(np.minimum(table[-1][:-wide], table[-1][wide:]))
        wide *= 2
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k, t in enumerate(table):
        some = np.flatnonzero(level == k)
        out[some] = np.minimum(t[lo[some] + 1], t[hi[some] + 1 - (1 << k)])
    return out


def repeated_starts(strings: list[bytes], length: int = LENGTH, window: int = WINDOW, modulus: int = MODULUS) -> list[np.ndarray]:
    """For each string, where substrings of `length` bytes start that also start elsewhere in one of the strings.

    By prefix-free parsing. A phrase reaches from one trigger window to the end of the next one, or from and
    to a string's ends. A substring starts in the phrase whose next window begins after it. If that window
    ends within the substring, its order is that of the phrase's suffix, then that of the parse from the
    next phrase on; otherwise the phrase's suffix holds it.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    if sizes.max(initial=0) < length:
        return [np.zeros(0, np.int64) for _ in strings]
    data = b"".join(strings)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(data)
    owner = np.repeat(np.arange(len(strings)), sizes)
    # Phrases: each string's first byte and its trigger windows begin them.
    begins = np.zeros(n, bool)
    begins[starts[sizes > 0]] = True
    if n >= window:
        hit = np.flatnonzero(rolling(np.frombuffer(data, np.uint8), window) % np.uint64(modulus) == 0)
        begins[hit[hit + window <= ends[owner[hit]]]] = True
    first = np.flatnonzero(begins)
    who = owner[first]
    last = np.r_[who[1:] != who[:-1], True][: len(first)]
    stop = np.where(last, ends[who], np.r_[first[1:], 0] + window)
    # The dictionary, and the ranks of its suffixes to `length` bytes.
    number: dict[bytes, int] = {}
    phrase = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], np.int64)
    held = np.array([len(p) for p in number], np.int64)
    held_end = np.cumsum(held)
    held_start = held_end - held
    suffix = suffix_ranks(b"".join(number), length, np.repeat(held_end, held))
    # The parse: the order of its suffixes, by the ranks of phrases, and common prefixes of neighbours in bytes.
    rank = np.empty(len(number), np.int64)
    rank[[number[q] for q in sorted(number)]] = np.arange(len(number))
    rank = rank[phrase]
    after_last = np.searchsorted(who, who, "right")
    levels = doubled(rank, after_last, 1, 1 << int(np.bincount(who).max(initial=1)).bit_length())
    order = np.argsort(levels[-1], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        both = np.flatnonzero((a + step <= after_last[order[:-1]]) & (b + step <= after_last[order[1:]]))
        both = both[levels[k][a[both]] == levels[k][b[both]]]
        # Equal ranks of as many phrases; ranks of suffixes that end sooner differ from those that go on.
        a[both] += step
        b[both] += step
    past = np.r_[first, 0]
    shared = np.where(a < after_last[order[:-1]], past[a], ends[who[order[:-1]]]) - first[order[:-1]]
    more = np.flatnonzero((a < after_last[order[:-1]]) & (b < after_last[order[1:]]) & (shared < length))
    raw = np.frombuffer(data + bytes(length), np.uint8)
    for at in range(0, len(more), 20_000):
        some = more[at : at + 20_000]
        most = np.minimum(stop[a[some]] - first[a[some]], stop[b[some]] - first[b[some]])
        same = raw[first[a[some]][:, None] + np.arange(length)] == raw[first[b[some]][:, None] + np.arange(length)]
        shared[some] += np.minimum(np.where(same.all(1), length, same.argmin(1)), most)
    common = np.r_[0, shared]
    # All substrings of the corpus: the phrase that each starts in, and the rank of the phrase's suffix from there.
    counts = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(strings)), counts)
    x = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[which] + x
    p = np.searchsorted(first, at, "right") - 1
    own = suffix[held_start[phrase[p]] + at - first[p]]
    rest = length - (stop[p] - at - window)
    goes_on = ~last[p] & (stop[p] - at <= length)
    again = np.zeros(len(at), bool)
    within = np.flatnonzero(~goes_on)
    again[within] = (np.bincount(own[within], minlength=1) > 1)[own[within]]
    across = np.flatnonzero(goes_on)
    across = across[np.argsort(own[across] * (len(order) + 1) + place[np.minimum(p[across] + 1, len(order) - 1)])]
    near = np.flatnonzero(own[across[1:]] == own[across[:-1]])
    lo, hi = place[p[across[near]] + 1], place[p[across[near + 1]] + 1]
    near = near[least_between(common, lo, hi) >= rest[across[near]]] if len(near) else near
    again[across[near]] = True
    again[across[near + 1]] = True
    found = np.flatnonzero(again)
    return np.split(x[found], np.cumsum(np.bincount(which[found], minlength=len(strings)))[:-1])


def runs(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as rows of (first, last) of consecutive ones."""
    if not len(x):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(x) > 1)
    return np.stack([x[np.r_[0, cut + 1]], x[np.r_[cut, len(x) - 1]]], 1)


def pack(intervals: np.ndarray) -> bytes:
    return np.ascontiguousarray(intervals, dtype="<i8").tobytes()


def result(raw: bytes, starts: np.ndarray, length: int) -> tuple[int, int, int, str, bytes]:
    """n_bytes, n_removed, n_spans, kept_sha256 and the removed runs, from rows of (first, last) start of repeated strings."""
    if not len(starts):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), b""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, starts[:, 0], 1)
    np.add.at(edge, starts[:, 1] + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = runs(np.flatnonzero(gone))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), pack(spans + [0, 1])


#: What is known of a passage's strings: repeated; repeated, and its bytes are for comparison; to be compared.
SURE, GIVES, OPEN = 0, 1, 2
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs.

    `removed` holds pairs of (start, end) as little-endian 64-bit integers. Null and empty texts have no
    bytes; texts shorter than `length` lose none. Rows with equal texts, repeated rows too, count as
    different places. Null ids stay; other columns are not read. No rows in: no rows out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Texts without a whole string are done; they take no part in any join.
    whole = F.coalesce(F.octet_length("text") >= length, F.lit(False))
    bare = F.coalesce("text", F.lit(""))
    brief = docs.where(~whole).select("doc_id", F.octet_length(bare).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(bare, 256).alias("kept_sha256"), F.unhex(F.lit("")).alias("removed"))
    docs = docs.where(whole)
    passages = parsed(docs, length, gram)
    ends = [f(c).alias(f"{n}_{c}") for c in ("p1", "p2") for f, n in ((F.min, "least"), (F.max, "most"))]
    triggers = passages.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    # Written first, so that the join's two sides are dealt out anew and hot triggers can be split.
    triggers = materialize(triggers.selectExpr("trigger", "least_p1 = most_p1 AND least_p2 = most_p2 AS same"), "triggers")
    shared = materialize(passages.join(triggers, "trigger"), "parse")
    # The dictionary: passages that share a trigger with another one. One that occurs twice is repeated for
    # certain; of its places the least one gives its bytes, which other passages are compared with.
    least = F.struct("doc_id", "k1", "k2", "place")
    dictionary = shared.where("NOT same").groupBy("trigger", "p1", "p2").agg(F.count(F.lit(1)).alias("m"), F.min(least).alias("least"))
    dictionary = materialize(dictionary, "dictionary")
    crowds = dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > HOT)
    crowds = materialize(crowds.select("trigger", F.lit(True).alias("hot")), "crowds")
    crowded = not crowds.isEmpty()
    known = dictionary.join(crowds, "trigger", "left")
    rest = shared.where("NOT same").join(known, ["trigger", "p1", "p2"])
    gives = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2")) & (F.col("place") == F.col("least.place"))
    state = F.when(F.col("m") == 1, OPEN).when(gives, GIVES).otherwise(SURE)
    entry = lambda state, hot, doc: F.struct("place", state.alias("state"), "trigger", hot.alias("hot"), doc.alias("doc"))
    entries = shared.where("same").select("k1", "k2", entry(F.lit(SURE), F.lit(False), F.lit(None).cast("long")).alias("e"))
    entries = entries.union(rest.select("k1", "k2", entry(state, F.coalesce("hot", F.lit(False)), F.col("least.doc_id")).alias("e")))
    by_text = materialize(entries.distinct().groupBy("k1", "k2").agg(F.collect_list("e").alias("found")), "entries")
    both = with_keys(docs).join(by_text, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "raw", "found")

    def first_pass():
        def run(batch):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "open", "raw")}
            for doc, raw, found in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                found = [(f["place"] >> SPAN_BITS, (f["place"] >> SPAN_BITS) + (f["place"] & (1 << SPAN_BITS) - 1), f) for f in found or []]
                sure = np.array([(lo, hi) for lo, hi, f in found if f["state"] != OPEN], np.int64).reshape(-1, 2)
                wait = any(f["state"] == OPEN for *_, f in found)
                give = [(lo, hi, f["hot"], f["trigger"]) for lo, hi, f in found if f["state"] == OPEN or f["state"] == GIVES and f["doc"] == doc]
                row = (len(raw), None, None, None, pack(sure)) if wait else result(raw, sure, length)
                more = (pack(np.array(give, np.int64)), raw) if give else (None, None)
                for k, v in zip(out, (*row, *more), strict=True):
                    out[k].append(v)
            return {"doc_id": batch.column(0), "k1": batch.column(1), "k2": batch.column(2), **out}

        return run

    first = materialize(map_batches(both, f"doc_id long, k1 long, k2 long, {RESULT}, open binary, raw binary", first_pass, most=SLICE), "first-pass")
    discard(triggers, shared, dictionary, crowds, by_text)

    def opened(batch, hot: bool) -> tuple[list, ...]:
        """(trigger, k1, k2, lo, bytes) of the passages that wait for comparison, of triggers that are hot or not."""
        rows = []
        for k1, k2, rest, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(trigger, k1, k2, lo, raw[lo : hi + length]) for lo, hi, h, trigger in np.frombuffer(rest, "<i8").reshape(-1, 4).tolist() if bool(h) == hot]
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [], [], [])

    def passages_of():
        return lambda batch: dict(zip(("trigger", "k1", "k2", "lo", "bytes"), opened(batch, False), strict=True))

    waiting = first.where("open IS NOT NULL").select("k1", "k2", "open", "raw")
    few = map_batches(waiting, "trigger long, k1 long, k2 long, lo long, bytes binary", passages_of, most=SLICE)

    def compare(batches):
        held: list[tuple[int, int, int, int, bytes]] = []

        def settle(rows):
            k1s, k2s, spans = [], [], []
            for (_, k1, k2, lo, _), x in zip(rows, repeated_starts([r[4] for r in rows], length), strict=True):
                if len(x):
                    k1s.append(k1)
                    k2s.append(k2)
                    spans.append(pack(runs(x) + lo))
            return pa.RecordBatch.from_arrays([pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), pa.array(spans, pa.binary())], names=["k1", "k2", "starts"])

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > DICTIONARY and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settle(held)
        held.clear()
        trim()

    cold = few.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(compare, "k1 long, k2 long, starts binary")

    # Strings of triggers that very many passages share: by digest, counted with partial sums in each task.
    def strings_of():
        def run(batch):
            _, k1, k2, lo, raws = opened(batch, True)
            if not raws:
                return None
            size = np.array([len(r) for r in raws])
            count = size - length + 1
            who = np.repeat(np.arange(len(size)), count)
            x = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            at = (np.cumsum(size) - size)[who] + x
            h1, h2 = digests(np.frombuffer(b"".join(raws), np.uint8), at, at + length)
            return {k: pa.array(v) for k, v in (("k1", np.array(k1)[who]), ("k2", np.array(k2)[who]), ("x", np.array(lo)[who] + x), ("h1", h1), ("h2", h2))}

        return run

    found = cold
    if crowded:
        strings = map_batches(waiting, "k1 long, k2 long, x long, h1 long, h2 long", strings_of, most=PART)
        again = materialize(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h1", "h2"), "again")
        found = cold.union(strings.join(again, ["h1", "h2"]).select("k1", "k2", F.concat(le64("x"), le64("x")).alias("starts")))
    starts = materialize(found.groupBy("k1", "k2").agg(F.collect_list("starts").alias("found")), "starts")
    if crowded:
        discard(again)
    late = first.where("n_removed IS NULL").select("doc_id", "k1", "k2", "removed", "raw").join(starts, ["k1", "k2"], "left").select("doc_id", "removed", "raw", "found")

    def second_pass():
        def run(batch):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")}
            for sure, raw, found in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                starts = np.frombuffer(b"".join([sure, *(found or [])]), "<i8").reshape(-1, 2)
                for k, v in zip(out, result(raw, starts, length), strict=True):
                    out[k].append(v)
            return {"doc_id": batch.column(0), **out}

        return run

    done = first.where("n_removed IS NOT NULL").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
    return done.unionByName(map_batches(late, f"doc_id long, {RESULT}", second_pass, most=SLICE)).unionByName(brief)


def le64(column: str):
    """A whole number as eight little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(F.col(column), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)]))


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, raw): texts as bytes with their key."""

    def make():
        def run(batch):
            raws = [t.encode() for t in batch.column(1).to_pylist()]
            keys = text_keys(raws)
            return {"doc_id": batch.column(0), "k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]), "raw": raws}

        return run

    return map_batches(docs, "doc_id long, k1 long, k2 long, raw binary", make, most=SLICE)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over documents: strings of 200 bytes, one row a document; null and empty texts have no bytes."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def oracle() -> str:
    """The same removals as DuckDB SQL, by all strings: texts are hexadecimal there, two digits a byte."""
    n = LENGTH
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, x, md5(substr(h, 2 * x + 1, {2 * n})) AS s FROM t, unnest(range(0, greatest(len(h) // 2 - {n - 1}, 0))) AS r(x)),
hits AS (SELECT doc_id, x FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
marked AS (SELECT doc_id, x, coalesce(x > lag(x) OVER (PARTITION BY doc_id ORDER BY x) + {n}, true)::INT AS new FROM hits),
grouped AS (SELECT doc_id, x, sum(new) OVER (PARTITION BY doc_id ORDER BY x) AS g FROM marked),
spans AS (SELECT doc_id, min(x) AS a, max(x) + {n} AS b FROM grouped GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, coalesce(2 * (b - a), len(h))), '' ORDER BY a) AS h FROM gaps g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, (len(t.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM t LEFT JOIN sums s ON s.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id"""
