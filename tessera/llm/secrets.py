"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

One pass over each text finds the keywords of all rules at once; a rule's regular expression is tried
only where one of its keywords begins. Token formats that embed a CRC-32 are reported only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, read_table

# Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = ("assign", "access", "hex")
# Keywords and the rule that each of them opens.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
MIN_ASSIGN, MIN_ACCESS = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, starts array<int>, ends array<int>, kinds array<string>"


def base62_crc(body: str) -> str:
    """CRC-32 of the body in base 62, six digits: the checksum that such tokens carry at their end."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word) - 1, kind))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret in code points, by start and then kind. Null and empty: none.

    Expressions are tried at keyword hits from left to right; a match, kept or dropped, is passed over
    before the next one of its kind begins.
    """
    if not text:
        return []
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    low = text.lower()
    if len(low) != len(text):  # the one character whose lower case is longer
        low = text.replace("İ", "i").lower()
    hits = sorted((end - back, kind) for end, (back, kind) in automaton().iter(low))
    past = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                past[kind] = m.end()
                if len(m[2]) >= MIN_ASSIGN:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                past[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    found.append((at, m.end(), kind))
        elif (m := (GITHUB if kind == "github" else NPM).match(text, at)) and base62_crc(m[1]) == m[2]:
            past[kind] = m.end()
            found.append((at, m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, a digest of the base spans, all spans as text and as arrays.

    Null or empty texts: no spans (the digest of an empty string). Null ids and repeated rows stay as
    they are; other columns of docs are not read. No rows in: no rows out.
    """

    def make():
        def run(batch):
            ids, out = batch.column(0), {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "starts", "ends", "kinds")}
            for text in batch.column(1).to_pylist():
                spans = find(text)
                kinds = [k for _, _, k in spans]
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE_KINDS)
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
                out["starts"].append([a for a, _, _ in spans])
                out["ends"].append([b for _, b, _ in spans])
                out["kinds"].append(kinds)
            return {"doc_id": ids, **out}

        return run

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), SCHEMA, make)


def redact_text(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each maximal run of secret spans replaced by a mask."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in find(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return text if not out else "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with secrets masked in the text column; all rows and other columns stay."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(s):
        return s.map(lambda t: redact_text(t, mask), na_action="ignore")

    from tessera.llm.common import tune

    tune(docs.sparkSession)
    return docs.withColumn(text_col, clean(F.col(text_col)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over documents: one row a document, whole texts; null and empty texts have no spans."""
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def oracle() -> str:
    """The same scan as DuckDB SQL, by expressions alone: places come from the lengths of what lies between matches."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    assign = f"({names})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    # A token's keyword, and then the text up to the next one: 36 letters and digits, and no more of them.
    carrying = " UNION ALL ".join(f"SELECT {k} AS k, '{KINDS[k]}' AS kind, r, t, '{word}' AS re FROM texts WHERE regexp_matches(t, '{word}')" for k, word in ((3, "gh[pousr]_"), (4, "npm_")))
    plain = " UNION ALL ".join(
        f"SELECT {k} AS k, '{KINDS[k]}' AS kind, r, regexp_extract_all(t, '{e}') AS found, string_split_regex(t, '{e}') AS between FROM texts"
        for k, e in ((0, assign), (1, "AKIA[A-Z0-9]+"), (2, "[0-9a-f]+"))
    )
    digit = lambda n: f"substr('{BASE62}', (crc // {62**n} % 62 + 1)::INT, 1)"
    step = "list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
plain AS ({plain}),
pieces AS (SELECT k, kind, r, unnest(found) AS s, unnest(between[1:len(found)]) AS before, generate_subscripts(found, 1) AS i FROM plain WHERE len(found) > 0),
placed AS (SELECT k, kind, r, s, (sum(length(before) + length(s)) OVER (PARTITION BY k, r ORDER BY i) - length(s))::BIGINT AS a FROM pieces),
base AS (
  SELECT k, kind, r, a, a + length(s) AS b FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(s, '^{assign}$', 2)) >= {MIN_ASSIGN} WHEN 'access' THEN length(s) >= {MIN_ACCESS} ELSE length(s) >= 24 END),
carrying AS ({carrying}),
heads AS (
  SELECT k, kind, r, unnest(between[2:]) AS after, generate_subscripts(between[2:], 1) AS i, len(between) - 1 AS n, unnest(between[1:len(between) - 1]) AS before
  FROM (SELECT *, string_split_regex(t, re) AS between FROM carrying)),
tokens AS (
  SELECT k, kind, r, after, (sum(length(before) + 4) OVER (PARTITION BY k, r ORDER BY i) - 4)::BIGINT AS a, i, n FROM heads),
summed AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(substr(after, 1, 30), ''), lambda c: ascii(c)::UBIGINT)), lambda c, b: {step})) AS crc
  FROM tokens WHERE length(regexp_extract(after, '^[0-9A-Za-z]+')) = 36 AND (length(after) > 36 OR i = n)),
checked AS (SELECT k, kind, r, a, a + 40 AS b FROM summed WHERE substr(after, 31, 6) = {" || ".join(digit(n) for n in range(5, -1, -1))}),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM checked),
told AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k <= 2) AS based, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (r)"""
