"""Media columns: progressive JPEG files, decoded scan by scan into coefficient arrays and RGB tensors.

`decode` reads any progressive Huffman-coded JPEG of 8-bit samples: spectral-selection and
successive-approximation scans accumulate in one coefficient array a component, which is dequantised,
inverse-transformed in numpy, upsampled and turned into a full-resolution RGB tensor. Scans whose codes
have one length are read at once with array operations, others symbol by symbol.

`encode_payload` stores bytes without loss: the unit of the format is the coefficient, so a byte b is the
coefficient 256 + b, 64 bytes to a block. All of them lie between 256 and 511, so that each has nine
magnitude bits and none is zero; first scans then have codes of one length and refinements are bit planes.
Luma takes four of every six blocks and the two chroma components, of half the resolution, one each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, read_table

#: Most MCUs in a row of a stored payload; more go to further rows, all of one length.
COLUMNS = 256
#: Bytes of texts or files taken at once: planes and tensors are several times as large.
SLICE = 1 << 20
#: Most samples of a side.
MOST = 65_535
#: What reading a file that isn't a whole progressive JPEG raises.
BROKEN = (TypeError, ValueError, KeyError, IndexError, StopIteration, struct.error)
BASE = 256
LOW = 2
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@cache
def zigzag() -> np.ndarray:
    """Natural index of each zigzag position: diagonals, walked in alternating directions."""
    cells = sorted(((r + c, c if (r + c) % 2 == 0 else r, r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for *_, r, c in cells])


SCALE = 14


@cache
def inverse_basis() -> np.ndarray:
    """Sample by zigzag coefficient, as whole numbers scaled by 2**SCALE: sums are exact, whatever their order."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("au,bv->abuv", one, one).reshape(64, 64)
    return np.rint(both[:, zigzag()].T * (1 << SCALE))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, number: int, codes: dict[int, int]) -> bytes:
    """A table segment for symbols by the lengths of their codes."""
    order = sorted(codes, key=lambda s: (codes[s], s))
    return segment(0xC4, bytes([kind << 4 | number, *(sum(n == k for n in codes.values()) for k in range(1, 17)), *order]))


def scan(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, data: list[bytes]) -> bytes:
    """A scan segment of (component, DC table, AC table) with its entropy-coded data, stuffed, restart markers between them."""
    body = bytes([len(parts), *(x for c, d, a in parts for x in (c, d << 4 | a)), first, last, high << 4 | low])
    coded = [x.replace(b"\xff", b"\xff\x00") for x in data]
    return segment(0xDA, body) + b"".join(bytes([0xFF, 0xD0 + (k - 1) % 8]) * (k > 0) + x for k, x in enumerate(coded))


def packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones as the format has it."""
    fill = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits).tobytes()


def end_of_band(blocks: int) -> list[tuple[int, np.ndarray]]:
    """Runs of at most 32,767 blocks: (blocks, bits of the run's four-bit code and of its length)."""
    out = []
    while blocks:
        run = min(blocks, 32767)
        n = run.bit_length() - 1
        value = (n << n) | (run - (1 << n))
        out.append((run, np.array([value >> k & 1 for k in range(n + 3, -1, -1)], np.uint8)))
        blocks -= run
    return out


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def encode_payload(payload: bytes, restart: int = 0) -> bytes:
    """A progressive JPEG that holds the payload, whose length is a positive multiple of 64, in its coefficients.

    With `restart`, a marker stands after so many MCUs, from which reading can begin again.
    """
    units = len(payload) // 64
    mcus = -(-units // 6)
    # A side has at most MOST samples: very long payloads are wider.
    rows = min(-(-mcus // COLUMNS), MOST // 16)
    columns = -(-mcus // rows)
    mcus = rows * columns
    blocks = np.zeros((6 * mcus, 64), np.uint8)
    blocks[:units] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    planes = [blocks[: 4 * mcus], blocks[4 * mcus : 5 * mcus], blocks[5 * mcus :]]
    out = [
        b"\xff\xd8",
        segment(0xFE, b"payload " + str(len(payload)).encode()),
        segment(0xDB, bytes([0]) + b"\1" * 64),
        segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        huffman(0, 0, {0: 1, 1: 2}),
        huffman(1, 0, {9 - LOW: 1}),
        huffman(1, 1, {n << 4: 4 for n in range(15)}),
    ]
    if restart:
        out.append(segment(0xDD, struct.pack(">H", restart)))
    spans = lambda n: [(at, min(at + restart, n)) for at in range(0, n, restart)] if restart else [(0, n)]
    # DC: its top bit is 1 everywhere, so differences are 1, in each component's first block, and then 0.
    dc = np.empty((mcus, 6), np.uint8)
    dc[:, :4] = planes[0][:, 0].reshape(rows, 2, columns, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    dc[:, 4], dc[:, 5] = planes[1][:, 0], planes[2][:, 0]
    head = np.array([1, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0, 1], np.uint8)
    together = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    out.append(scan(together, 0, 0, 0, 8, [packed(np.concatenate([head, np.zeros(6 * (b - a - 1), np.uint8)])) for a, b in spans(mcus)]))
    bands = [(1, planes[0], 1, 5), (1, planes[0], 6, 63), (2, planes[1], 1, 63), (3, planes[2], 1, 63)]
    # AC: a code of one zero bit, then the seven bits from 64 + (b >> 2): a byte each.
    for c, plane, a, b in bands:
        data = plane[:, a : b + 1] >> LOW | (BASE >> LOW)
        out.append(scan([(c, 0, 0)], a, b, 0, LOW, [data[i:j].tobytes() for i, j in spans(len(plane))]))

    def refined(plane: np.ndarray, a: int, b: int, low: int) -> bytes:
        bits, at = [], 0
        for run, code in end_of_band(len(plane)):
            bits += [code, (plane[at : at + run, a : b + 1] >> low & 1).ravel()]
            at += run
        return packed(np.concatenate(bits))

    for low in range(7, -1, -1):
        out.append(scan(together, 0, 0, low + 1, low, [packed(dc[i:j].ravel() >> low & 1) for i, j in spans(mcus)]))
        if low >= LOW:
            continue
        for c, plane, a, b in bands:
            out.append(scan([(c, 0, 1)], a, b, low + 1, low, [refined(plane[i:j], a, b, low) for i, j in spans(len(plane))]))
    return b"".join([*out, b"\xff\xd9"])


class Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table = number, h, v, table

    def shape(self, width: int, height: int, most_h: int, most_v: int) -> None:
        """Blocks that scans of this component alone have, and blocks with those that fill up MCUs."""
        self.wide, self.high = -(-width * self.h // (8 * most_h)), -(-height * self.v // (8 * most_v))
        self.columns, self.rows = -(-width // (8 * most_h)) * self.h, -(-height // (8 * most_v)) * self.v
        self.coefficients = np.zeros((self.rows * self.columns, 64), np.int32)

    def alone(self) -> np.ndarray | slice:
        if self.wide == self.columns and self.high == self.rows:
            return slice(None)
        return (np.arange(self.high)[:, None] * self.columns + np.arange(self.wide)).ravel()

    def in_mcus(self) -> np.ndarray:
        """Block indices by MCU, in the order of interleaved scans."""
        at = np.arange(self.rows * self.columns).reshape(self.rows // self.v, self.v, self.columns // self.h, self.h)
        return at.transpose(0, 2, 1, 3).reshape(-1, self.v * self.h)


class Bits:
    """Entropy-coded data of a scan without stuffing, read bit by bit."""

    def __init__(self, data: bytes):
        self.array = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0
        self._list: list[int] | None = None

    def take(self, n: int) -> int:
        if self._list is None:
            self._list = self.array.tolist()
        value = 0
        for b in self._list[self.at : self.at + n]:
            value = value << 1 | b
        if self.at + n > len(self._list):
            raise ValueError("jpeg: data end early")
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := table.get((n, code))) is not None:
                return s
        raise ValueError("jpeg: no such code")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        value = self.take(n)
        return value if value >> (n - 1) else value - (1 << n) + 1

    def run(self, n: int) -> np.ndarray:
        if self.at + n > len(self.array):
            raise ValueError("jpeg: data end early")
        self.at += n
        return self.array[self.at - n : self.at]


def codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def places_of(parts: list) -> list[np.ndarray]:
    """Block indices of each component of a scan, a row an MCU: in a scan of one component a block is one."""
    if len(parts) > 1:
        return [c.in_mcus() for c, *_ in parts]
    c = parts[0][0]
    return [np.arange(len(c.coefficients))[c.alone()].reshape(-1, 1)]


def dc_first(parts: list, places: list[np.ndarray], bits: Bits, tables: dict, low: int) -> None:
    places = [(c, p, tables[0, d]) for (c, d, _), p in zip(parts, places, strict=True)]
    lengths = {n for *_, t in places for (n, _), s in t.items() if s == 0}
    blocks = sum(p.size for _, p, _ in places)
    # Where each component's first block alone differs from the one before, the rest are codes of "no difference".
    before = dict.fromkeys((c.number for c, *_ in places), 0)
    values = [np.zeros(p.shape, np.int32) for _, p, _ in places]
    mcus = len(places[0][1])
    for m in range(mcus):
        if m and lengths == {1} and all(t.get((1, 0)) == 0 for *_, t in places):
            rest = blocks // mcus * (mcus - m)
            if bits.at + rest <= len(bits.array) and not bits.array[bits.at : bits.at + rest].any():
                bits.at += rest
                for v, (c, *_) in zip(values, places, strict=True):
                    v[m:] = before[c.number]
                break
        for v, (c, p, t) in zip(values, places, strict=True):
            for k in range(p.shape[1]):
                before[c.number] += bits.signed(bits.symbol(t))
                v[m, k] = before[c.number]
    for v, (c, p, _) in zip(values, places, strict=True):
        c.coefficients[p.ravel(), 0] = v.ravel() << low


def dc_refine(parts: list, places: list[np.ndarray], bits: Bits, low: int) -> None:
    width = sum(p.shape[1] for p in places)
    plane = bits.run(width * len(places[0])).reshape(-1, width).astype(np.int32) << low
    at = 0
    for (c, *_), p in zip(parts, places, strict=True):
        c.coefficients[p.ravel(), 0] |= plane[:, at : at + p.shape[1]].ravel()
        at += p.shape[1]


def ac_first(c: Component, index: np.ndarray | slice, bits: Bits, table: dict, a: int, b: int, low: int) -> None:
    order = np.arange(len(c.coefficients))[index]
    blocks = len(order)
    if len(table) == 1:
        # One code: every coefficient of the band has the same size and stands next to the one before.
        ((n, code), symbol) = next(iter(table.items()))
        size, many = symbol & 15, blocks * (b - a + 1)
        if symbol >> 4 == 0 and size:
            rows = bits.run(many * (n + size)).reshape(many, n + size)
            if n + size == 8:
                whole = np.packbits(rows).astype(np.int32)
            else:
                whole = rows.astype(np.int32) @ (1 << np.arange(n + size - 1, -1, -1))
            if (whole >> size != code).any():
                raise ValueError("jpeg: no such code")
            value = whole & (1 << size) - 1
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
            c.coefficients[index, a : b + 1] = value.reshape(blocks, -1) << low
            return
    run = 0
    for at in order.tolist():
        if run:
            run -= 1
            continue
        k = a
        while k <= b:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                c.coefficients[at, k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0) - 1
                break


def ac_refine(c: Component, index: np.ndarray | slice, bits: Bits, table: dict, a: int, b: int, low: int) -> None:
    order = np.arange(len(c.coefficients))[index]
    one, at, blocks = 1 << low, 0, len(order)

    def correct(some: np.ndarray, k: int) -> None:
        """A bit for each coefficient from k on that isn't zero so far, away from zero."""
        band = c.coefficients[some, k : b + 1]
        full = band != 0
        plane = bits.run(int(np.count_nonzero(full)))
        if full.all():
            band += np.where(band > 0, one, -one) * plane.reshape(band.shape)
        else:
            band[full] += np.where(band[full] > 0, one, -one) * plane
        c.coefficients[some, k : b + 1] = band

    while at < blocks:
        k, row = a, c.coefficients[order[at]]
        while k <= b:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                correct(order[at : at + 1], k)
                if run > 1:
                    correct(order[at + 1 : at + run], a)
                at += run - 1
                break
            value = (one if bits.take(1) else -one) if size else 0
            while k <= b:
                if row[k]:
                    if bits.take(1):
                        row[k] += one if row[k] > 0 else -one
                elif zeros:
                    zeros -= 1
                else:
                    row[k] = value
                    k += 1
                    break
                k += 1
        at += 1


def scans_of(data: bytes) -> tuple[dict, list[Component]]:
    """Header fields, and the components with the coefficients that all scans have left in them."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("jpeg: no start of image")
    head, tables, quant, components, at = {"comments": [], "restart": 0}, {}, {}, [], 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("jpeg: no marker")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            head["comments"].append(body)
        elif marker == 0xDD:
            (head["restart"],) = struct.unpack(">H", body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = codes(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif marker == 0xC2:
            _, head["height"], head["width"], count = struct.unpack_from(">BHHB", body)
            components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            head["h"], head["v"] = max(c.h for c in components), max(c.v for c in components)
            for c in components:
                c.shape(head["width"], head["height"], head["h"], head["v"])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("jpeg: not progressive")
        elif marker == 0xDA:
            by = {c.number: c for c in components}
            parts = [(by[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            first, last, step = body[-3:]
            stretches, start, end = [], at, at
            while True:
                end = data.find(b"\xff", end)
                if end < 0:
                    raise ValueError("jpeg: data end early")
                if data[end + 1] != 0:
                    stretches.append(data[start:end])
                    if not 0xD0 <= data[end + 1] <= 0xD7:
                        break
                    start = end + 2
                end += 2
            at, high, low = end, step >> 4, step & 15
            c, table = parts[0][0], tables.get((1, parts[0][2]))
            if not head["restart"] and first:
                (ac_refine if high else ac_first)(c, c.alone(), Bits(stretches[0]), table, first, last, low)
                continue
            places = places_of(parts)
            many = head["restart"] or len(places[0])
            if len(stretches) != -(-len(places[0]) // many):
                raise ValueError("jpeg: wrong number of restart markers")
            # Each stretch is a scan of its own of the next so many MCUs.
            for k, stretch in enumerate(stretches):
                here = [p[k * many : (k + 1) * many] for p in places]
                if first:
                    (ac_refine if high else ac_first)(c, here[0].ravel(), Bits(stretch), table, first, last, low)
                elif high:
                    dc_refine(parts, here, Bits(stretch), low)
                else:
                    dc_first(parts, here, Bits(stretch), tables, low)
    head["quant"] = quant
    return head, components


def samples(c: Component, quant: np.ndarray) -> np.ndarray:
    """A component's plane, 0 to 255."""
    # Doubles hold these whole numbers exactly.
    flat = c.coefficients.astype(np.float64)
    if (quant != 1).any():
        flat *= quant
    flat = flat @ inverse_basis()
    flat *= 2.0**-SCALE
    flat += 128.5
    np.clip(flat, 0, 255, out=flat)
    return flat.astype(np.uint8).reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.columns)


@cache
def chroma_parts() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a chroma sample adds to red (Cr), green (Cb and Cr) and blue (Cb), in 64ths."""
    at = np.arange(256) - 128
    return tuple(np.rint(64 * k * at).astype(np.int16) for k in (1.402, -0.344136, -0.714136, 1.772))


def tensor(head: dict, components: list[Component]) -> np.ndarray:
    """Height by width by three: chroma upsampled by repeating its samples, YCbCr turned into RGB."""
    height, width = head["height"], head["width"]
    planes = [samples(c, head["quant"][c.table]) for c in components]
    if len(planes) == 1:
        return np.repeat(planes[0][:height, :width, None], 3, 2)
    y, cb, cr = planes[:3]
    if components[1].h != components[2].h or components[1].v != components[2].v:
        cb, cr = (p.repeat(head["v"] // c.v, 0).repeat(head["h"] // c.h, 1) for c, p in ((components[1], cb), (components[2], cr)))
    if components[0].h < head["h"] or components[0].v < head["v"]:
        y = y.repeat(head["v"] // components[0].v, 0).repeat(head["h"] // components[0].h, 1)
    red, green, also, blue = chroma_parts()
    up, over = y.shape[0] // cb.shape[0], y.shape[1] // cb.shape[1]
    wide = y.reshape(cb.shape[0], up, cb.shape[1], over).astype(np.int16)
    out = np.empty((*wide.shape, 3), np.uint8)
    for k, add in enumerate((red[cr], green[cb] + also[cr], blue[cb])):
        channel = wide + (add + 32 >> 6)[:, None, :, None]
        np.clip(channel, 0, 255, out=channel)
        out[..., k] = channel
    return out.reshape(*y.shape, 3)[:height, :width]


def decode(data: bytes) -> np.ndarray:
    """The RGB tensor of a progressive JPEG; ValueError for anything else."""
    return tensor(*scans_of(data))


def payload_of(head: dict, components: list[Component]) -> bytes:
    """The bytes that encode_payload stored."""
    size = next(int(x[8:]) for x in head["comments"] if x.startswith(b"payload "))
    all_of = np.concatenate([c.coefficients for c in components]) - BASE
    if all_of.min() < 0 or all_of.max() > 255:
        raise ValueError("jpeg: no payload")
    return all_of.astype(np.uint8).tobytes()[:size]


def feature(rgb: np.ndarray) -> str:
    """Size, each channel's mean and count of full samples, and a checksum of a tensor."""
    h, w, _ = rgb.shape
    flat = rgb.reshape(-1, 3)
    mean = [int(flat[:, k].sum(dtype=np.int64)) // len(flat) for k in range(3)]
    white = [int(np.count_nonzero(flat[:, k] == 255)) for k in range(3)]
    return f"{w}x{h}:" + ",".join(f"{m}/{n}" for m, n in zip(mean, white, strict=True)) + f":{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column from texts: one row for each row of docs with the text's UTF-8 length and its JPEG.

    Null and empty texts become a file of one block of zeros. Null ids and repeated rows stay; other
    columns are not read. No rows in: no rows out.
    """

    def make():
        def run(batch):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_bytes": [len(x) for x in raw], "media": [encode_payload(padded(x)) for x in raw]}

        return run

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), MEDIA_SCHEMA, make, most=SLICE)


def read_media(media: DataFrame) -> DataFrame:
    """Decode each stored file (doc_id, n_bytes, media): digests of payload and file, and the tensor's features.

    Media that are null, or that aren't files of store_texts(): null in all columns but the given ones and the
    file's size and digest. Null ids and repeated rows stay. No rows in: no rows out.
    """

    def make():
        def run(batch):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in batch.column(2).to_pylist():
                try:
                    head, components = scans_of(data)
                    payload = payload_of(head, components)
                    found = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature(tensor(head, components)))
                except BROKEN:
                    found = (None,) * 4
                own = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                for k, v in zip(out, (*found[:3], *own, found[3]), strict=True):
                    out[k].append(v)
            return {"doc_id": batch.column(0), "n_bytes": batch.column(1), **out}

        return run

    return map_batches(media, READ_SCHEMA, make, most=SLICE)


def decode_column(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with `tensor`: height, width and full-resolution RGB bytes of each file, null for null or other data."""
    schema = "struct<height: int, width: int, rgb: binary>"

    from pyspark.sql.functions import pandas_udf

    @pandas_udf(schema)
    def tensors(s):
        import pandas as pd

        rows = []
        for data in s:
            try:
                rgb = decode(bytes(data))
                rows.append((rgb.shape[0], rgb.shape[1], rgb.tobytes()))
            except BROKEN:
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["height", "width", "rgb"])

    from tessera.llm.common import tune

    tune(df.sparkSession)
    return df.withColumn("tensor", tensors(F.col(media_col)))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over documents: one row a document, whole texts; null and empty texts are one unit of zeros."""
    return read_media(store_texts(read_table(spark, sf_dir, "documents")))
