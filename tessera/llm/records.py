"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record file is a run of frames, as TFRecord files have them:

    length   unsigned 64-bit, little-endian
    check    masked CRC-32C of the eight bytes before, unsigned 32-bit
    data     `length` bytes
    check    masked CRC-32C of the data, unsigned 32-bit

The data of a record are the ids of one document, little-endian, two bytes each if the vocabulary allows
it and else four. Documents stand in ascending order of their id, over files by number and within a file.
The index is a Parquet table (shard, position, doc_id, offset, length, n_tokens): a reader that wants
records in any order takes rows of it, seeks to `offset` and reads one frame.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import Memory
from tessera.llm.common import read_table, scratch, slices, tune

#: Bytes after which a task begins another file.
SHARD_BYTES = 64 << 20
#: A space beside white space, as bpe.UNEVEN, spelled out for Arrow's expressions.
WHITE = r"\t\n\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNEVEN = f" [ {WHITE}]|[{WHITE}] "
#: Bytes of texts that are encoded at once.
GATHER = 8 << 20
#: A stop or comma at a word's end that is a piece of its own.
STOPPED = r"[\pL\pN][.,]$"
#: Words to a line when they are encoded together.
JOINED = 500
#: Words and pieces that a worker remembers, twice at most.
WORDS, PIECES = 600_000, 50_000
#: Fixed values of the format: the polynomial of CRC-32C, reflected, and the mask's addend.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 512
INDEX_SCHEMA = "shard string, position long, doc_id long, offset long, length long, n_tokens long"
READ_SCHEMA = "doc_id long, shard string, position long, start_in_shard long, n_tokens long, ids_crc32 long"


@cache
def crc_tables() -> tuple[np.ndarray, list[list[int]]]:
    """What a byte adds to the checksum of a block by its place there, and a state's shift over a block, by state byte."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    place = np.zeros((BLOCK, 256), np.uint32)
    place[-1] = byte
    for j in range(BLOCK - 2, -1, -1):
        place[j] = byte[place[j + 1] & 0xFF] ^ (place[j + 1] >> 8)
    return place.ravel(), [place[k].tolist() for k in range(4)]


def crc32c(data: bytes) -> int:
    """CRC-32C, by its linearity: table values of a block's bytes are combined at once, blocks in turn."""
    place, shift = crc_tables()
    if len(data) < 4:
        last, state = place[-256:], 0xFFFFFFFF
        for b in data:
            state = int(last[(state ^ b) & 0xFF]) ^ (state >> 8)
        return state ^ 0xFFFFFFFF
    blocks = -(-len(data) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    at = len(padded) - len(data)
    padded[at:] = np.frombuffer(data, np.uint8)
    padded[at : at + 4] ^= 0xFF
    values = np.empty(blocks, np.uint32)
    where = np.arange(BLOCK) * 256
    for k in range(0, blocks, 256):
        values[k : k + 256] = np.bitwise_xor.reduce(place[where + padded[k * BLOCK : (k + 256) * BLOCK].reshape(-1, BLOCK)], axis=1)
    s0, s1, s2, s3 = shift
    state = 0
    for v in values.tolist():
        state = s0[state & 0xFF] ^ s1[state >> 8 & 0xFF] ^ s2[state >> 16 & 0xFF] ^ s3[state >> 24] ^ v
    return state ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


@cache
def masked_length(length: bytes) -> int:
    return masked(length)


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))))


def unframe(raw: bytes) -> bytes:
    """The data of one whole frame; ValueError if a length or checksum is wrong."""
    (length,) = struct.unpack_from("<Q", raw)
    if len(raw) != length + 16 or struct.unpack_from("<I", raw, 8)[0] != masked(raw[:8]):
        raise ValueError("record: wrong length")
    data = raw[12:-4]
    if struct.unpack_from("<I", raw, 12 + length)[0] != masked(data):
        raise ValueError("record: wrong checksum")
    return data


def file_system(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHER) -> Iterator[pa.RecordBatch]:
    """Batches joined to about so many bytes: the more words at once, the fewer of them are distinct."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


@cache
class Pieces:
    """Encodes texts with a tokenizer file of the tokenizers library, each distinct piece of its splitter once.

    One a worker process, whatever the number of its tasks.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.find = regex.compile(pattern).findall
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memory = Memory(self.find, self.encode_pieces, self.encode_words, WORDS, PIECES)
        # Tokens added to the vocabulary stand for their content wherever a text has it; between them it is plain text.
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("tokenizer: added tokens that take more than their content")
        self.added = {t.content: i.to_bytes(self.width, "little") for i, t in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else lambda t: [t]
        self.stops = {c: self.encode_pieces([c])[c] for c in ".,"}
        #: Whether a token begins with a space, which the byte-level alphabet writes as U+0120.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, null counting as empty, as the library's plain call gives them."""
        parts = [self.cut(t or "") for t in texts]
        plain = iter(self.memory.encode([x for p in parts for x in p[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(plain) for k, x in enumerate(p)) for p in parts]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: np.array(e.ids, f"<u{self.width}").tobytes() for p, e in zip(pieces, found, strict=True)}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space before it.

        A full stop or comma after a letter or digit is a piece of its own, so that the word is encoded
        without it. Words are encoded many to a line, and cut at tokens that begin with a space.
        """
        ends = {w: w[:-1] for w in words if len(w) > 1 and w[-1] in self.stops and w[-2].isalnum()}
        plain = list({ends.get(w, w) for w in words})
        found = dict(zip(plain, self.encode_plain(plain), strict=True))
        return [found[ends[w]] + self.stops[w[-1]] if w in ends else found[w] for w in words]

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty. Words are split and numbered by Arrow, and only distinct ones looked up."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        for content in self.added:
            uneven = pc.or_(uneven, pc.match_substring(texts, content))
        out = np.empty(len(texts), object)
        odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        for k, ids in zip(odd.tolist(), self.encode(texts.take(pa.array(odd)).to_pylist()), strict=True):
            out[k] = ids
        even = np.flatnonzero(pc.invert(uneven).to_numpy(zero_copy_only=False))
        if not len(even):
            return out.tolist()
        lists = pc.split_pattern(texts.take(pa.array(even)), " ")
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten()
        numbered = words.dictionary_encode()
        index = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        entries = self.of_distinct(numbered.dictionary)
        # A text's first word has no space before it: each is an entry of its own, after the distinct ones.
        index[cuts[:-1]] = len(entries) + np.arange(len(even))
        entries += self.memory.split_and_encode(words.take(pa.array(cuts[:-1])).to_pylist())
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        start = np.cumsum(size) - size
        table = np.frombuffer(b"".join(entries), f"<u{self.width}")
        many = size[index]
        ends = np.cumsum(many)
        ids = table[np.repeat(start[index] - (ends - many), many) + np.arange(ends[-1])]
        stops = np.r_[0, ends][cuts].tolist()
        for k, a, b in zip(even.tolist(), stops, stops[1:], strict=False):
            out[k] = ids[a:b].tobytes()
        return out.tolist()

    def of_distinct(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words, each with a space before it: looked up without a stop at their ends, so that fewer are distinct."""
        stopped = pc.match_substring_regex(words, STOPPED)
        ended = words.filter(stopped)
        stems = pa.concat_arrays([words.filter(pc.invert(stopped)), pc.utf8_slice_codeunits(ended, 0, -1)]).dictionary_encode()
        found = np.empty(len(stems.dictionary), object)
        found[:] = self.memory.words.of_list(stems.dictionary.to_pylist(), self.encode_plain)
        each = found[stems.indices.to_numpy(zero_copy_only=False)]
        plain = len(words) - len(ended)
        marks = np.empty(len(ended), object)
        marks[:] = self.stops["."]
        marks[pc.ends_with(ended, ",").to_numpy(zero_copy_only=False)] = self.stops[","]
        out = np.empty(len(words), object)
        mask = stopped.to_numpy(zero_copy_only=False)
        out[~mask] = each[:plain]
        out[mask] = each[plain:] + marks
        return out.tolist()

    def encode_plain(self, words: list[str]) -> list[bytes]:
        some = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        found = self.tokenizer.encode_batch_fast([" " + " ".join(w) for w in some], add_special_tokens=False)
        out: list[bytes] = []
        for group, e in zip(some, found, strict=True):
            ids = np.array(e.ids, f"<u{self.width}")
            cuts = (np.flatnonzero(self.opens[ids]) * self.width).tolist()
            raw = ids.tobytes()
            if len(cuts) == len(group) and not cuts[0]:
                cuts.append(len(raw))
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:  # white space at a word's end
                out += self.memory.split_and_encode([" " + w for w in group])
        return out


def write(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as record files and an index under folder, a URI that every executor reaches.

    `pattern` is the expression by which the tokenizer splits, so that distinct pieces are encoded once.
    Null and empty texts become a record of the end id alone (or of no ids). An added token's content in a
    text becomes its id, as in the library. Null ids come first; rows
    with equal ids stand in the order of their texts, repeated rows are kept. Columns other than the two
    named are not read. No rows: an empty index. A task writes under a name of its own attempt and then
    renames, so that a task that runs again after a lost executor replaces what the first run left.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, base = file_system(folder)
        coder = Pieces(tokenizer, pattern)
        end = b"" if end_id is None else end_id.to_bytes(coder.width, "little")
        schema = pa.schema([("shard", pa.string()), ("position", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])
        out, name, number, at, position = None, "", 0, 0, 0

        def close():
            out.close()
            fs.move(f"{base}/{name}.{attempt}", f"{base}/{name}")

        for batch in gathered(batches):
            for some in slices(batch, batch.num_rows, GATHER):
                ids, rows = some.column(0).to_pylist(), []
                for doc, data in zip(ids, coder.encode_array(some.column(1)), strict=True):
                    if out is None:
                        name, at, position = f"records-{part:08d}-{number:04d}", 0, 0
                        out, number = fs.open_output_stream(f"{base}/{name}.{attempt}"), number + 1
                    raw = frame(data + end)
                    out.write(raw)
                    rows.append((name, position, doc, at, len(raw), (len(data) + len(end)) // coder.width))
                    at, position = at + len(raw), position + 1
                    if at >= SHARD_BYTES:
                        close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if out is not None:
            close()

    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """Read every record back through the index, checking its sums: one row a record.

    start_in_shard counts the ids of the file before it; ids_crc32 is of the ids as unsigned 32-bit integers.
    """
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        held, source, start = None, None, 0
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.string()), ("position", pa.int64()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["shard"] != held:
                    held, start = x["shard"], 0
                    source = fs.open_input_stream(f"{base}/{held}", buffer_size=1 << 20)
                    at = 0
                if x["offset"] != at:
                    raise ValueError("record: the index doesn't fit the file")
                data = unframe(source.read(x["length"]))
                at += x["length"]
                ids = np.frombuffer(data, f"<u{width}")
                if len(ids) != x["n_tokens"]:
                    raise ValueError("record: wrong number of ids")
                rows.append((x["doc_id"], held, x["position"], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    return index.repartition("shard").sortWithinPartitions("shard", "position").mapInArrow(run, READ_SCHEMA)


def read_one(folder: str, shard: str, offset: int, length: int, width: int) -> np.ndarray:
    """The ids of one record, by its row of the index: what a shuffled reader does."""
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{shard}") as f:
        return np.frombuffer(unframe(f.read_at(length, offset)), f"<u{width}")


def with_starts(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """records with `start`: the ids of all documents before each one.

    Files are summed in groups of ten thousand tasks' by their names, and groups by one row each.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("some", F.substring("shard", len("records-") + 1, 4))
    before = lambda by: F.sum("n").over(by) - F.col("n")
    groups = files.groupBy("some").agg(F.sum("n").alias("n")).select("some", before(Window.orderBy("some")).alias("first"))
    bases = files.withColumn("base", before(Window.partitionBy("some").orderBy("shard"))).join(groups, "some")
    return records.join(bases.select("shard", (F.col("first") + F.col("base")).alias("base")), "shard").withColumn("start", F.col("base") + F.col("start_in_shard"))


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over documents: one row a document, from the records; null and empty texts have the end id alone."""
    import public_tokenizers

    folder = scratch(spark, "token-records")
    write(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return with_starts(spark, folder, read(spark, folder, 2)).select("doc_id", "start", "n_tokens", "ids_crc32")
