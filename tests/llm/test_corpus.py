"""Operators over the whole corpus against brute force, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, minhash, suffix
from tessera.llm.components import connected
from tests.llm.cases import TEXTS, empty, frame

BLANKS = " \t\n\x0b\x0c\r"


def words(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        low = low.replace(b, " ")
    w = low.split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(rows, n=4):
    """Least id reachable, by all pairs."""
    sets = [words(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        least[find(k)].append(d)
    return [min((d for d in least[find(k)] if d is not None), default=None) for k in range(len(rows))], [len(s) for s in sets]


def near_texts(seed=1, families=12):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 4, 30, 120)))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((100 + len(rows), rng.choice((" ", "\n", "\t ")).join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("part", "n"), [(2_000_000, 4), (300, 4), (2_000_000, 5), (300, 7)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, part, n):
    monkeypatch.setattr(minhash, "PART", part)
    rows = near_texts() + TEXTS
    want, sizes = classes(rows, n)
    got = minhash.near_duplicates(frame(spark, rows), words=n).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((d, n, c, d == c) for (d, _), c, n in zip(rows, want, sizes, strict=True))


@pytest.mark.parametrize(("star", "part"), [(100_000, 2_000_000), (400, 900)])
def test_drifting_families_equal_all_pairs(spark, monkeypatch, star, part):
    """Texts that change word by word, away from one beginning and back: members of many rings, with and without links."""
    monkeypatch.setattr(minhash, "STAR", star)
    monkeypatch.setattr(minhash, "PART", part)
    rng = random.Random(17)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        now = list(base)
        for _ in range(45):
            for _ in range(rng.choice((1, 1, 2, 6))):
                k = rng.randrange(90)
                now[k] = base[k] if rng.random() < 0.3 else f"x{rng.randrange(10**6)}"
            rows.append((1000 - len(rows), " ".join(now)))
    want, sizes = classes(rows, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), words=4).collect()}
    assert got == {d: (n, c) for (d, _), n, c in zip(rows, sizes, want, strict=True)}
    assert 4 < len(set(want)) < 120


def test_no_near_duplicates(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert all(r["kept"] for r in minhash.near_duplicates(frame(spark, [(1, "a b c d e"), (2, None)])).collect())


def test_deduplicated_keeps_a_row_of_each_group(spark):
    """One row a component, by rows: repeated rows, copies under a kept row's id and null ids too."""
    base = near_texts(seed=3)
    other = [f"word{k}" for k in range(40)]
    rows = base + base[:5] + [(base[0][0], " ".join(other)), (None, " ".join(other)), (None, base[1][1]), (1, None), (1, None), (2, "\t"), (None, "")]
    want, _ = classes(rows, 5)
    groups = defaultdict(list)
    for k, ((d, t), c) in enumerate(zip(rows, want, strict=True)):
        groups[c if words(t, 5) else (k,)].append((d is None, d or 0, t or "", d))
    least = Counter((d, t or None) for *_, t, d in map(min, groups.values()))
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, kept_id string, OWN_ID string, digest string")
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns
    got = Counter((r["doc_id"], r["text"] if words(r["text"], 5) else None) for r in got.collect())
    assert sum(got.values()) == sum(least.values()) and {d for d, _ in got} == {d for d, _ in least}
    assert all(n == 1 for (_, t), n in got.items() if t)
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_word_hashes_hold_against_constructed_words():
    """Thue-Morse words collide under every polynomial modulo a power of two."""
    a = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    x, y, z = minhash.shingle_sets(pa.array([f"{a} one two three four", f"{b} one two three four", f"{b.upper()} one\x0btwo\tthree  four\n"]), 4)
    assert len(x) == 2 and len(set(x.tolist()) & set(y.tolist())) == 1 and y.tolist() == z.tolist()


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    t = minhash.sketches([a, b, pool[:1], np.zeros(0, np.uint64)])
    assert abs((t[0] == t[1]).mean() - 1500 / 2500) < 0.15
    assert (t != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_connected(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (5, 5), (None, 4), (13, 14)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(texts, n=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), len(suffix.runs(np.flatnonzero(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 900))) for _ in range(12)]
    texts = base + [b[: len(b) // 2] + "X" + b[len(b) // 2 :] for b in base] + [base[3][100:350] + base[5], "a" * 700, "ab" * 300, base[7], "a" * 199, "b" * 200, "b" * 201, "é" * 300, base[2][:250] * 2]
    return [(k, t) for k, t in enumerate(texts)] + [(50, None), (51, ""), (None, base[1]), (3, base[3])]


@pytest.mark.parametrize(("hot", "part", "dictionary"), [(2000, 1 << 19, 1 << 20), (1, 300, 500)])
def test_repeats_equal_all_strings(spark, monkeypatch, hot, part, dictionary):
    for k, v in (("HOT", hot), ("PART", part), ("DICTIONARY", dictionary)):
        monkeypatch.setattr(suffix, k, v)
    rows = repeated_texts()
    want = Counter((d, *x) for (d, _), x in zip(rows, cut([t for _, t in rows]), strict=True))
    got = suffix.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_parse_in_parts_covers_every_string(monkeypatch):
    monkeypatch.setattr(suffix, "PART", 333)
    raw = random.Random(8).randbytes(2000)
    *_, lo, hi = suffix.parse([raw, b"", b"x" * 199])
    assert sorted(x for a, b in zip(lo, hi, strict=True) for x in range(a, b + 1)) == list(range(1801))


def test_suffix_ranks_are_the_order():
    raw = bytes(random.Random(9).choice(b"ab") for _ in range(600))
    r = suffix.suffix_ranks(raw, 20)
    for i in range(0, 570, 13):
        for j in range(0, 570, 17):
            assert (r[i] < r[j]) == (raw[i : i + 20] < raw[j : j + 20])


def test_prefix_free_parsing_equals_all_strings():
    rng = random.Random(12)
    for _ in range(300):
        n, letters = rng.choice((5, 12, 20, 40)), rng.choice((b"a", b"ab", b"abcd", bytes(range(256))))
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(1, 6))]
        strings = []
        for _ in range(rng.randint(0, 14)):
            a, b = rng.choice(base), rng.choice(base)
            strings.append(a[rng.randint(0, len(a)) :] + b[: rng.randint(0, len(b))])
        seen = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        want = [[i for i in range(len(s) - n + 1) if seen[s[i : i + n]] > 1] for s in strings]
        for window, modulus in ((3, 4), (2, 1), (4, 7), (3, 50)):
            assert [x.tolist() for x in suffix.repeated_starts(strings, n, window, modulus)] == want


def test_digests_tell_strings_apart():
    a = bytes(ord("ab"[k.bit_count() & 1]) for k in range(4096))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    raw = a + b + a + b"\0" * 300
    at = np.array([0, 4096, 8192, 12288, 12289])
    d = list(zip(*(x.tolist() for x in suffix.digests(np.frombuffer(raw, np.uint8), at, at + [4096, 4096, 4096, 100, 101])), strict=True))
    assert d[0] == d[2] and len(set(d)) == 4


def test_no_repeats(spark):
    assert suffix.remove_repeats(empty(spark)).count() == 0


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")


def leak_rows():
    rng = random.Random(6)
    common = [f"c{k}" for k in range(60)]
    make = lambda n, rare: " ".join(rng.choice(common) if rng.random() > rare else f"r{rng.randrange(5000)}" for _ in range(n))
    items = [(k, make(rng.choice((15, 40, 60, 150)), 0.5)) for k in range(12)]
    docs, want = [], set()
    for d in range(150):
        text = make(rng.choice((5, 80, 400)), 0.3)
        if d % 5 == 0:
            k, item = rng.choice(items)
            at = rng.randrange(len(text))
            item_words = item.split(" ")
            if d % 2:  # a paraphrase: every tenth word is another
                item_words[3::10] = [f"p{rng.randrange(10**6)}" for _ in item_words[3::10]]
            text = f"{text[:at]} {', '.join(item_words).upper() if d % 10 == 0 else ' '.join(item_words)} {text[at:]}"
            want.add((d, k))
        docs.append((d, text))
    return docs, items, want


def test_leaks(spark):
    docs, items, want = leak_rows()
    got = decontaminate.find_leaks(frame(spark, docs), benchmark(spark, [*items, (90, None), (91, "")])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["cosine"] >= decontaminate.COSINE and r["in_order"] >= decontaminate.IN_ORDER for r in got)
    kept = {r["doc_id"] for r in decontaminate.without_leaks(frame(spark, docs), benchmark(spark, items)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_leak_edges(spark):
    _, items, _ = leak_rows()
    assert decontaminate.find_leaks(empty(spark), benchmark(spark, items)).count() == 0
    assert decontaminate.find_leaks(frame(spark), benchmark(spark, [])).count() == 0
    assert decontaminate.find_leaks(frame(spark), benchmark(spark, [(1, None)])).count() == 0
    assert decontaminate.find_leaks(frame(spark), benchmark(spark, items)).count() == 0
    held = decontaminate.find_leaks(frame(spark, [*TEXTS, (None, items[1][1]), (7, items[1][1])]), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in held} == {(None, 1), (7, 1)}


def test_long_items_are_held_as_a_whole(spark):
    rng = random.Random(11)
    new = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = new(65), new(133), new(200)
    other = [" ".join(new(60)) for _ in range(500)]
    docs = [
        (1, " ".join(new(30) + a[-1:] + a[3:4] + new(30))),  # the last word and one more
        (2, " ".join(new(50) + b[-5:] + new(50))),
        (3, " ".join(new(50) + b[:67] + new(50))),  # half of an item
        (4, " ".join(new(50) + a + new(50))),
        (5, " ".join(new(50) + b + new(500) + c + new(50))),
        (6, " ".join(new(9) + c[:110] + new(900) + c[110:] + new(9))),  # in pieces far apart
        (7, " ".join(new(50) + b[:100] + new(33) + new(50))),  # three quarters, of which one part is half there
        (8, " ".join((c[:67] + new(200)) * 3)),  # one part three times
        *((100 + k, t) for k, t in enumerate(other)),
    ]
    items = [(k, " ".join(x)) for k, x in enumerate((a, b, c))]
    got = decontaminate.find_leaks(frame(spark, docs), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(4, 0), (5, 1), (5, 2), (6, 2), (7, 1)}
    assert all(len(p) > decontaminate.PART // 2 - 1 for _, p in decontaminate.Items([(k, t) for k, t in items], 1, {w.encode(): 1 for _, t in items for w in t.split()}).parts)


def paraphrase(item, kind, rng):
    w, n = list(item), len(item)
    if kind == "swapped":
        for k in range(3, n - 1, 10):
            w[k], w[k + 1] = w[k + 1], w[k]
    elif kind == "dropped":
        w = [x for k, x in enumerate(w) if k % 8 != 5]
    elif kind == "replaced":
        w = [f"p{rng.randrange(10**6)}" if k % 6 == 4 else x for k, x in enumerate(w)]
    elif kind == "inserted":
        w = [y for k, x in enumerate(w) for y in ((x, f"p{rng.randrange(10**6)}") if k % 4 == 1 else (x,))]
    elif kind == "halves":
        w = w[n // 2 :] + w[: n // 2]
    elif kind == "mixed":
        w = [f"p{rng.randrange(10**6)}" if k % 12 == 4 else x for k, x in enumerate(w) if k % 12 != 9]
        for k in range(6, len(w) - 1, 20):
            w[k], w[k + 1] = w[k + 1], w[k]
    return w


KINDS = ("same", "swapped", "dropped", "replaced", "inserted", "halves", "mixed")


def test_leaks_against_all_texts_and_items(spark):
    """Every text against every item without index words, space or cosine; paraphrases are to be found, nothing else."""
    rng = random.Random(21)
    zipf = [f"c{k}" for k in range(300)]
    make = lambda n: [zipf[min(int(rng.paretovariate(0.7)) - 1, 299)] if rng.random() < 0.6 else f"r{rng.randrange(3000)}" for _ in range(n)]
    items = [make(rng.randint(10, 64)) for _ in range(60)]
    docs, planted = [], {}
    for d in range(700):
        text = make(rng.choice((10, 90, 250)))
        if d < 420:
            item, kind = d % 60, KINDS[d // 60]
            at = rng.randrange(len(text))
            text[at:at] = paraphrase(items[item], kind, rng)
            planted[d, item] = kind
        docs.append((d, text))
    got = decontaminate.find_leaks(frame(spark, [(d, " ".join(t)) for d, t in docs]), benchmark(spark, [(k, " ".join(t)) for k, t in enumerate(items)])).collect()
    got = {(r["doc_id"], r["item_id"]) for r in got}
    frequency = Counter(w for _, t in docs for w in set(t))
    want = set()
    for k, item in enumerate(items):
        answer = sorted(set(item), key=lambda w: (frequency[w], w.encode()))[:5]
        for d, text in docs:
            if sum(w in text for w in answer) < 3 or len(set(item) - set(text)) > 0.3 * len(item):
                continue
            for at in range(max(len(text) - 2 * len(item), 0) + 1):
                some = text[at : at + 2 * len(item)]
                share, halves = decontaminate.in_order(item, some), sum(decontaminate.in_order(h, some) for h in (item[: len(item) // 2], item[len(item) // 2 :]))
                if share >= 0.7 * len(item) or halves >= 0.7 * len(item) and set(answer) <= set(some):
                    want.add((d, k))
                    break
    assert len(set(planted) - want) <= 0.02 * len(planted)  # a paraphrase can take an item's answer away
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
    recall = {kind: np.mean([p in got for p, x in planted.items() if x == kind]) for kind in KINDS}
    assert min(recall.values()) >= 0.9, recall


def test_short_items_stand_word_for_word(spark):
    rng = random.Random(5)
    fill = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    docs = [(k, " ".join(fill(60))) for k in range(60)]
    docs += [(100, " ".join([*fill(90), "Photosynthesis", *fill(90)])), (101, " ".join([*fill(20), "new,", "York", "CITY.", *fill(20)])), (102, " ".join(["new", *fill(9), "york", *fill(9), "city"])), (103, "photosynthesis")]
    items = [(1, "Photosynthesis"), (2, "New York City"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 nothing"), (4, "...")]
    got = decontaminate.find_leaks(frame(spark, docs), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(100, 1), (101, 2), (103, 1)}


def test_benchmarks_in_blocks(spark, monkeypatch):
    docs, items, want = leak_rows()
    monkeypatch.setattr(decontaminate, "BLOCK", 900)
    got = decontaminate.find_leaks(frame(spark, docs), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    kept = {r["doc_id"] for r in decontaminate.without_leaks(frame(spark, docs), benchmark(spark, items)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_singular_directions(spark, monkeypatch):
    """The singular values and directions of the passages' matrix, by an exact decomposition."""
    docs, items, _ = leak_rows()
    monkeypatch.setattr(decontaminate, "DIRECTIONS", 24)
    monkeypatch.setattr(decontaminate, "POWERS", 6)
    own = decontaminate.Items(items, len(docs), Counter(w for _, t in docs + items for w in set(decontaminate.words_of(t))))
    rows = []
    for _, t in docs:
        w = decontaminate.words_of(t)
        for at in range(0, len(w), decontaminate.STRIDE):
            rows.append(w[at : at + decontaminate.STRIDE * decontaminate.SPAN])
    a = own.vectors([*rows, *(p for _, p in own.parts)])
    exact = np.linalg.svd(a, full_matrices=False)
    directions, values = decontaminate.singular_directions(frame(spark, docs).select("text"), own)
    assert np.allclose(values[:8], exact[1][:8], rtol=0.02)
    assert np.allclose(np.linalg.norm(a @ directions[:, :8], axis=0), exact[1][:8], rtol=0.02)
    assert np.allclose(directions.T @ directions, np.eye(directions.shape[1]), atol=1e-8)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.in_order(a, b) == table[-1][-1]


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    docs = docs.unionByName(spark.createDataFrame([(10**6, "%%% 123", None, None, 7), (10**6 + 1, None, "en", "s", None)], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    state = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        state = stage(spark, state, sf_dir).cache()
        got = {r["doc_id"]: r for r in state.collect()}
        if k < 4:
            assert state.columns == names
        if k == 0:
            assert set(got) == {d for d, _ in kept}
        if k == 1:
            want, _ = classes(kept, 5)
            kept = [r for r, c in zip(kept, want, strict=True) if r[0] == c]
            assert set(got) == {d for d, _ in kept}
        if k == 2:
            items = [" ".join(x.decode() for x in decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = [(d, t) for d, t in kept if not any(i in " ".join(x.decode() for x in decontaminate.words_of(t)) for i in items)]
            assert set(got) == {d for d, _ in clean}
        if k == 3:
            assert set(got) == {d for d, _ in clean} and not any("token = \"" in r["text"] and len(r["text"].split("token = \"")[1]) > 40 and r["text"].split("token = \"")[1][:40].isalnum() for r in got.values())
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
            texts = {d: r["text"] for d, r in got.items()}
    assert set(got) == set(texts)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[d].encode()).hexdigest() and 4 * r["n_tokens"] == len(r["ids"]) for d, r in got.items())


def test_scratch_tables(spark, tmp_path):
    from types import SimpleNamespace

    from tessera.llm import common

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(unset(master))
    assert common.shared_dir(unset("local[2]")).startswith("file:")
    table = common.materialize(spark.range(5), "five")
    assert table.count() == 5
    common.discard(table)
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(table.written_to).count()
