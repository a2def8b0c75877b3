"""Every operator over a text of megabytes, whose telling parts stand at its very end; and the pipeline's stages over clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import bpe, decontaminate, html, jpeg, langid, licenses, minhash, records, secrets, suffix

RNG = random.Random(31)
WORDS = [f"{a}{b}" for a in ("the", "river", "stone", "garden", "letter", "winter", "harbour") for b in ("", "s", "side", "less", "like", "work", "man", "bed", "path", "wall")]
ITEM = " ".join(f"item{RNG.randrange(10**6)}" for _ in range(30))
PASSAGE = " ".join(RNG.choice(WORDS) + str(RNG.randrange(10**6)) for _ in range(40))
BODY = " ".join(RNG.choice(WORDS) + (str(RNG.randrange(10**5)) if RNG.random() < 0.3 else "") for _ in range(250_000))
TEXT = f"{PASSAGE}\n{BODY}\n{PASSAGE} x\n{ITEM}\nLicensed under the MIT License.\ntoken = abcdef123456"


@pytest.fixture(scope="module")
def docs(spark):
    assert len(TEXT) > 2_000_000
    return spark.createDataFrame([(1, TEXT), (2, "short"), (3, TEXT + " and more")], "doc_id long, text string").repartition(2)


def only(df, doc=1):
    return df.where(f"doc_id = {doc}").collect()[0]


def test_ids_of_a_long_text(spark, docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    row = only(bpe.encode_decode(docs))
    assert bytes(row["decoded"]) == TEXT.encode() and row["n_tokens"] * 4 == len(row["ids"])
    folder, path = f"file://{tmp_path}/records", P.path("byte_bpe_50k.json")
    records.write(docs, folder, path, P.PATTERN, end_id=2)
    at = spark.read.parquet(f"{folder}/index").where("doc_id = 1").collect()[0]
    ids = records.read_one(folder, at["shard"], at["offset"], at["length"], 2)
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(TEXT, add_special_tokens=False).ids, 2]


def test_rows_of_a_long_text(docs):
    assert only(secrets.scan(docs))["spans"] == f"assign:{len(TEXT) - 20}:{len(TEXT)}"
    assert only(licenses.scan(docs))["families"] == "mit"
    model = langid.Model([(" ".join(WORDS), "en"), ("der fluss und die brücke", "de")])
    assert only(langid.predict(docs, model))["lang_pred"] == "en"
    got = only(jpeg.read_media(jpeg.store_texts(docs)))
    assert got["payload_sha256"] == hashlib.sha256(jpeg.padded(TEXT.encode())).hexdigest()
    page = f"<body><nav><a href=/>Home</a></nav><article><p>{TEXT.replace(chr(10), '</p><p>')}</p></article><footer>Imprint.</footer>"
    assert html.main_text(page) == TEXT.replace("\n", "\n\n")


def test_places_in_a_long_text(spark, docs):
    got = only(suffix.remove_repeats(docs.where("doc_id < 3")))
    size = len(PASSAGE)
    spans = np.frombuffer(bytes(got["removed"]), "<i8").reshape(-1, 2).tolist()
    assert spans == [[0, size], [len(PASSAGE) + len(BODY) + 2, 2 * size + len(BODY) + 2]] and got["n_removed"] == 2 * size
    items = spark.createDataFrame([(5, ITEM), (6, "nowhere to be found")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()} == {(1, 5), (3, 5)}
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 1}


def test_stages_leave_clashing_columns(spark):
    import corpus_pipeline as pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    names = ("kept_id", "told", "own_id", "own_digest", "kept_digest", "sid", "digest", "component_id", "text_key", "item_id", "clean", "Told_")
    docs = base.selectExpr("*", *(f"'{n}' AS {n}" for n in names))
    docs = docs.union(docs.limit(5)).union(docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *(c for c in docs.columns if c != "doc_id")))
    state = docs
    for name, stage in pipeline.STAGES[:-1]:
        state = stage(spark, state, "/root/testdata/sf0.001").cache()
        assert state.columns == docs.columns, name
        assert all(r[n] == n for r in state.collect() for n in names)
    ids = [r["doc_id"] for r in state.collect()]
    assert len(ids) == len(set(ids)) and None not in ids
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
