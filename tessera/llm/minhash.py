"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has COORDINATES bins. In each round every shingle is hashed to a bin and a value, and each bin
keeps its least (round, value); in the first COORDINATES rounds the bin is hashed too, in round
COORDINATES + k it is bin k, so that every bin fills. Two sketches agree in a bin with the probability of
the sets' similarity, concentrated as for independent hashes. Bands of ROWS bins become bucket keys: a pair
of similarity 0.8 misses all of the 32 bands with probability 5e-8.

Shingles are hashed to 64 bits from 124-bit digests of their words. Equal sets are one node. Each bucket has a
centre, the node that shares the most buckets, and joins the centre's family: two nodes of one bucket are in
one family. Members are compared with their centre on the full sets, and with each other where their distances
from it allow a link and don't tie them already: no link between two nodes of a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_batches, materialize, read_table, trim, unused
from tessera.llm.components import connected
from tessera.llm.hashing import BASE, MULTIPLIERS, digests, mix

COORDINATES, ROWS = 128, 4
#: Link sets whose intersection times PER is at least AT_LEAST times their union.
AT_LEAST, PER = 80, 100
WORDS = 5
#: Shingles of a family that one task compares with its centre, and those of a ring that a task holds.
STAR, PART = 100_000, 2_000_000
SKETCH_SCHEMA = "doc_id long, digest binary, n_shingles long, sid binary, bands array<long>"
SETS_SCHEMA = "sid binary, shingles binary"


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of each text as sorted 64-bit hashes of its distinct shingles.

    Words are split and folded by Arrow, whose ASCII white space is the bytes 0x20 and 0x09 to 0x0D. With
    fewer words than a shingle has, the whole sequence is one; without words, or null: an empty set.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    edges = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_string(flat.type) else np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    some = np.diff(edges) > 0
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    h1, h2 = digests(data, edges[:-1][some], edges[1:][some])
    word = mix(mix(h1.view(np.uint64)) + h2.view(np.uint64) * MULTIPLIERS[2])
    ends = np.r_[0, np.cumsum(some)][np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    place = [mix(np.array([k + 1], np.uint64) * BASE) | np.uint64(1) for k in range(words + 1)]

    def joined(columns: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(columns[0]), mix(np.array([len(columns)], np.uint64))[0])
        for k, c in enumerate(columns):
            total += c * place[k]
        return mix(total)

    n = len(word)
    whole = joined([word[k : n - words + 1 + k] for k in range(words)]) if n >= words else word[:0]
    out = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        else:
            out.append(joined([word[k : k + 1] for k in range(a, b)]) if b > a else word[:0])
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each set, none of them empty; empty sets get a row of zeros."""
    sizes = np.array([len(s) for s in sets])
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full((len(sets), t), none)
    flat = table.reshape(-1)
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    for r in range(2 * t):
        if not len(items):
            break
        h = mix(items + np.uint64((r + 1) * int(BASE) & (1 << 64) - 1))
        value = (np.uint64(r) << np.uint64(55)) | (h >> np.uint64(9))
        if r < t:
            at = owner * t + ((h & np.uint64(511)) * np.uint64(t) >> np.uint64(9)).astype(np.int64)
        else:
            at = owner * t + (r - t)
        np.minimum.at(flat, at, value)
        open_ = (table == none).any(1)
        if not open_.all():
            keep = open_[owner]
            items, owner = items[keep], owner[keep]
    table[sizes == 0] = 0
    return table


def bands(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of each sketch, one a band."""
    groups = table.reshape(len(table), -1, rows)
    key = np.zeros(groups.shape[:2], np.uint64)
    for k in range(rows):
        key = mix(key * MULTIPLIERS[2] + groups[:, :, k])
    return mix(key + np.arange(groups.shape[1], dtype=np.uint64) * MULTIPLIERS[3]).view(np.int64)


def set_id(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, digest, n_shingles, sid, bands) of each row of (doc_id, digest, text); sid is a digest of the set, null if empty."""

    def make():
        def run(batch):
            sets = shingle_sets(batch.column(2), words)
            keys = bands(sketches(sets)).tolist()
            return {
                "doc_id": batch.column(0),
                "digest": batch.column(1),
                "n_shingles": [len(s) for s in sets],
                "sid": [set_id(s) for s in sets],
                "bands": [k if len(s) else None for k, s in zip(keys, sets, strict=True)],
            }

        return run

    return map_batches(docs, SKETCH_SCHEMA, make)


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(sid, shingles as sorted 64-bit integers) of each row of (doc_id, text) with a set."""

    def make():
        def run(batch):
            sets = [s for s in shingle_sets(batch.column(1), words) if len(s)]
            return {"sid": [set_id(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return run

    return map_batches(docs.select("doc_id", "text"), SETS_SCHEMA, make)


def common_with(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many items each of the sets has in common with one, all of them sorted and none empty."""
    items = np.concatenate(sets)
    hit = one[np.minimum(np.searchsorted(one, items), len(one) - 1)] == items
    return np.add.reduceat(hit, np.cumsum([0, *(len(s) for s in sets[:-1])]), dtype=np.int64)


class Ties:
    """Components of names: says of each link whether it ties two of them together that weren't."""

    def __init__(self):
        self.root: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (up := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root[up]
        return x

    def tie(self, a: bytes, b: bytes) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[b] = a
        return a != b


def near_of(held: list[np.ndarray], ones: list[np.ndarray], at_least: int = AT_LEAST) -> Iterator[np.ndarray]:
    """For each of `ones`, the numbers of the held sets that are similar enough, by an index of the held sets' items."""
    items = np.concatenate(held)
    sizes = np.array([len(s) for s in held])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], np.repeat(np.arange(len(held)), sizes)[order]
    for s in ones:
        lo, hi = np.searchsorted(items, s), np.searchsorted(items, s, "right")
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(held))
        yield np.flatnonzero(PER * common >= at_least * (sizes + len(s) - common))


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, list[tuple]]]:
    """(key, whether the key is new, rows) for the rows of each batch that stand together under one key, their first columns."""
    before = None
    for batch in batches:
        held: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held[0][:keys], held[0][:keys] != before, held
                before, held = held[0][:keys], []
            held.append(row)
        if held:
            yield held[0][:keys], held[0][:keys] != before, held
            before = held[0][:keys]


def distances(families: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """(centre, sid, n, ring, near) of each member of a family (centre, sid, n) but its centre.

    near says that it is linked with the centre. A ring is as wide as a link is long: with t = 1 - at_least / PER,
    ring k has the members whose distance from the centre, one less the similarity, is k t or more and less than
    (k + 1) t. Members are dealt out by hash, STAR shingles to a task, and each task gets the centre.
    """
    parts = materialize(families.groupBy("centre").agg(F.ceil(F.sum("n") / STAR).cast("int").alias("parts")).where("parts > 1"), "parts")
    rows = families.join(parts, "centre", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    first = F.col("sid") == F.col("centre")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = rows.withColumn("part", F.explode(F.when(first, every).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")))))
    rows = rows.select("centre", "part", (~first).alias("later"), "sid").join(sets, "sid").select("centre", "part", "later", "sid", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for _, new, some in by_group(batches, 2):
            if new:
                centre, some = np.frombuffer(some[0][4], np.uint64), some[1:]
            if some:
                members = [np.frombuffer(r[4], np.uint64) for r in some]
                common = common_with(centre, members)
                n = np.array([len(s) for s in members])
                union = n + len(centre) - common
                ring = PER * (union - common) // (union * (PER - at_least)) if at_least < PER else np.zeros(len(n), np.int64)
                near = PER * common >= at_least * union
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], pa.binary()) for k in (0, 3)] + [pa.array(x) for x in (n, ring, near)], names=["centre", "sid", "n", "ring", "near"])
        trim()

    dealt = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "later")
    return materialize(dealt.mapInArrow(run, "centre binary, sid binary, n long, ring long, near boolean"), "distances")


def linked(families: DataFrame, sets: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """Links (a, b) between the members of each family (centre, sid, n): enough of them to tie its components.

    Members linked with the centre are tied by that. The distance being a metric, two members with a link lie
    in one ring around the centre or in neighbouring ones; those of ring 0 are tied already. So the members of each
    ring from 1 on are compared with their own ring and the one before. A ring is cut into parts of PART shingles by hash, and what it meets
    into parts of its own, and each pair of parts is a task's, so that none holds an unbounded group. A task holds
    one part in an index by shingle, passes the other through it, and gives links that tie something only.
    """
    star = distances(families, sets, at_least)
    ties = star.where("near").select(F.col("centre").alias("a"), F.col("sid").alias("b"))
    if at_least >= PER:
        return ties
    held = star.where("ring > 0").select("centre", F.col("ring").alias("r"), "sid", "n")
    groups = held.groupBy("centre", "r").agg(F.sum("n").alias("held")).select("centre", "r", "held", F.ceil(F.col("held") / PART).cast("int").alias("rows"))
    passed = star.select("centre", F.explode(F.array("ring", F.col("ring") + 1)).alias("r"), "sid", "n").where("r > 0").join(materialize(groups, "rings"), ["centre", "r"])
    # What is passed comes in parts no smaller than the index that each of them meets. A ring's members are passed
    # through its own index too: a lone member with no other to meet is left out.
    wide = passed.groupBy("centre", "r").agg(F.first("rows").alias("rows"), F.first("held").alias("held"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where("m > 1")
    columns = F.ceil(F.col("n") / F.greatest(F.lit(STAR), F.col("held") / F.col("rows"))).cast("int")
    wide = materialize(wide.select("centre", "r", "rows", columns.alias("columns")), "rings")
    pick = lambda parts: F.pmod(F.xxhash64("sid"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rows = held.join(wide, ["centre", "r"]).select("centre", "r", pick("rows").alias("i"), each("columns").alias("j"), F.lit(1).alias("side"), "sid")
    rows = rows.union(passed.drop("rows", "held").join(wide, ["centre", "r"]).select("centre", "r", each("rows").alias("i"), pick("columns").alias("j"), F.lit(2).alias("side"), "sid"))
    rows = rows.join(sets, "sid").select("centre", "r", "i", "j", "side", "sid", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index, ties = [], [], Ties()
        for _, new, some in by_group(batches, 4):
            if new:
                names, index, ties = [], [], Ties()
            own = [r for r in some if r[4] == 1]
            names += [r[5] for r in own]
            index += [np.frombuffer(r[6], np.uint64) for r in own]
            others = some[len(own) :]
            if others and names:
                found = []
                for r, near in zip(others, near_of(index, [np.frombuffer(r[6], np.uint64) for r in others], at_least), strict=True):
                    found += [(names[k], r[5]) for k in near.tolist() if names[k] != r[5] and ties.tie(names[k], r[5])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[e] for f in found], pa.binary()) for e in (0, 1)], names=["a", "b"])
        trim()

    dealt = rows.repartition("centre", "r", "i", "j").sortWithinPartitions("centre", "r", "i", "j", "side")
    return ties.union(dealt.mapInArrow(run, "a binary, b binary"))


def classify(docs: DataFrame, words: int, at_least: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows of (doc_id, digest, text), and for each set (sid, least) the least row of its component.

    A row is (whether its id is null, id, digest), so that null ids come last.
    """
    found = materialize(sketch_documents(docs, words), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    nodes = found.where("sid IS NOT NULL").groupBy("sid").agg(F.min(row).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    live = nodes.select("sid", "rep", "n", F.explode("bands").alias("band"))
    shared = live.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    live = materialize(live.join(shared, "band"), "buckets")
    hubs = live.groupBy("sid").agg(F.sum(F.col("m") - 1).alias("hub"), F.first("rep").alias("rep"))
    # Sorted and merged at every size: the ids of a whole corpus aren't to be broadcast. The digest tells rows
    # without an id apart, however many there are.
    reps = hubs.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest")).distinct().hint("merge")
    sets = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & F.col("digest").eqNullSafe(F.col("rep_digest")), "left_semi").select("doc_id", "text")
    sets = sets_of(sets, words).join(hubs.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "sets")
    buckets, live = live, live.select("sid", "n", "band").join(hubs.select("sid", "hub"), "sid")
    centres = live.groupBy("band").agg(F.max(F.struct("hub", "sid")).alias("c")).select("band", F.col("c.sid").alias("centre"))
    families = materialize(live.join(centres, "band").select("centre", "sid", "n").distinct(), "families")
    links = materialize(linked(families, sets, at_least), "links")
    discard(buckets, sets, families)
    roots = connected(links)
    classes = nodes.select("sid", "rep").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = classes.groupBy("root").agg(F.min("rep").alias("least"))
    return found, classes.join(least, "root").select("sid", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, at_least: int = AT_LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id and kept.

    component_id is the least id that is reachable over links, its own included; kept says that it is the
    row's own. Null or empty texts and texts without words are linked with nothing and kept. Rows with a
    null id count in links, but their id is never a component's unless all of its ids are null; they are
    kept only if so. Repeated rows with one id are all kept or all not: deduplicated() chooses among rows.
    Other columns are not read. No rows in: no rows out.
    """
    text = F.col(text_col).cast("string")
    found, named = classify(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")), words, at_least)
    out = found.select("doc_id", "n_shingles", "sid").join(named, "sid", "left")
    out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, at_least: int = AT_LEAST) -> DataFrame:
    """One row of each group of near copies, with all of its columns; rows whose text has no words all stay.

    The row with the least id stays, null ids last, and of rows with that id the one with the least digest
    of its text. Rows that agree in id and text are one; which of them stays is not said. Columns of any
    name are left alone. No rows in: no rows out.
    """
    digest, ident = F.unhex(F.sha2(F.col(text_col).cast("string"), 256)), F.col(id_col).cast("long")
    _, named = classify(docs.select(ident.alias("doc_id"), digest.alias("digest"), F.col(text_col).cast("string").alias("text")), words, at_least)
    own_id, own_digest, kept_id, kept_digest = (unused(n, docs) for n in ("own_id", "own_digest", "kept_id", "kept_digest"))
    kept = named.select(F.col("least.doc_id").alias(kept_id), F.col("least.digest").alias(kept_digest)).distinct()
    worded = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Repeated rows are merged before they are dealt out, then meet the kept ones where they lie.
    rows = docs.where(worded).withColumn(own_id, ident).withColumn(own_digest, digest).dropDuplicates([own_id, own_digest])
    rows = rows.join(kept.hint("merge"), F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_digest) == F.col(kept_digest)), "left_semi")
    return rows.drop(own_id, own_digest).union(docs.where(~worded))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over documents: shingles of four words, one row a document; null and empty texts are kept alone."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


def oracle(words: int = 4) -> str:
    """The same classes as DuckDB SQL, by all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE {PER} * c >= {AT_LEAST} * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS r FROM sets UNION SELECT e.b, r.r FROM reach r JOIN edges e ON e.a = r.a),
least AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON a = doc_id"""
