"""Byte-level BPE and token records against the libraries, and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe, records
from tests.llm.cases import TEXTS, empty, frame

random.seed(4)
ALPHABET = "ab \n\t's1é中🙂x​\x1c\x85   ßIt'll"
ODD = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 60))) for _ in range(400)] + ["a" * 3000, " " * 700 + "x", "é" * 400, "!" * 999, "a b\n", " a", "\n\n b"]


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs.from_tiktoken(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_encoding_equals_the_library(coder, library):
    texts = ODD + [t or "" for _, t in TEXTS]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_one_tree_equals_many(coder):
    pieces = ["".join(random.choice("abcdefgh") for _ in range(n)).encode() for n in (2, 3, 17, 64, 100)]
    for p in pieces:
        assert coder.encode_long(p) == coder.encode_alike([p], 1 << (len(p) - 1).bit_length())[0]


def test_a_full_memory_changes_nothing(coder):
    small = bpe.Memory(coder.find, coder.encode_pieces, words=5, pieces=5)
    assert [small.encode([t])[0] for t in ODD[:50] * 2] == coder.encode(ODD[:50]) * 2


def test_operator(spark, library):
    rows = bpe.digests(bpe.encode_decode(frame(spark))).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text in TEXTS:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        assert any(r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() for r in by[doc])
    assert bpe.encode_decode(empty(spark)).count() == 0


def test_checksum():
    assert records.crc32c(b"123456789") == 0xE3069283
    for n in (0, 1, 3, 4, 511, 512, 513, 2000):
        data = bytes(random.randrange(256) for _ in range(n))
        state = 0xFFFFFFFF
        for b in data:
            state ^= b
            for _ in range(8):
                state = state >> 1 ^ (records.POLYNOMIAL if state & 1 else 0)
        assert records.crc32c(data) == state ^ 0xFFFFFFFF


def test_frames():
    raw = records.frame(b"abc")
    assert records.unframe(raw) == b"abc"
    for k in range(len(raw)):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises(ValueError, match="record"):
            records.unframe(bytes(bad))


def test_pieces_equal_whole_texts():
    c = records.Pieces(P.path("byte_bpe_50k.json"), P.PATTERN)
    want = c.tokenizer.encode_batch_fast(ODD, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in c.encode(ODD)] == [e.ids for e in want]


def test_texts_with_added_tokens_as_in_a_plain_call():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain, c = Tokenizer.from_file(path), records.Pieces(path, P.PATTERN)
    end = "<|endoftext|>"
    texts = [f"{end} hello", f"a b{end}c d", end, f"{end}{end} \n", "<|endoftext", f"x  {end}\ty" * 50, "no token, at all", "", None]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [50256, 23748]
    for got in (c.encode(texts), c.encode_array(pa.array(texts))):
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_records(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/records"
    path = P.path("byte_bpe_50k.json")
    records.write(frame(spark), folder, path, P.PATTERN, end_id=2)
    rows = records.with_starts(spark, folder, records.read(spark, folder, 2)).orderBy("start").collect()
    c = records.Pieces(path, P.PATTERN)
    start = 0
    # Null ids first, then ascending; ties by text.
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [r["doc_id"] for r in rows] == [d for d, _ in order]
    for (_, text), r in zip(order, rows, strict=True):
        ids = np.append(np.frombuffer(c.encode([text])[0], "<u2"), 2).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = spark.read.parquet(f"{folder}/index").where("doc_id = 9").collect()[0]
    assert records.read_one(folder, one["shard"], one["offset"], one["length"], 2)[-1] == 2


def test_no_records(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    records.write(empty(spark), folder, P.path("byte_bpe_50k.json"), P.PATTERN, end_id=2)
    assert records.with_starts(spark, folder, records.read(spark, folder, 2)).count() == 0
