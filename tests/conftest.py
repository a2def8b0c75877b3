import os
import struct
import sys
import zlib

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TESTDATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session, ship_package

    s = build_session("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name, _, kind = f.partition(".")
        if kind == "parquet":
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def png(img) -> bytes:
    """An 8-bit PNG of an array, gray (H, W) or RGB (H, W, 3)."""
    h, w = img.shape[:2]
    rows = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
