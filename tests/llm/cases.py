"""Rows that every operator is to take: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = "the quick brown fox jumps over the lazy dog near the river bank . " * 900

TEXTS = [
    (1, "The and the of a bridge was opened to all of the traffic on Monday, after three long years."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "word"),
    (6, LONG),
    (7, LONG),
    (7, LONG),
    (None, "a row without an id, and with some words in it"),
    (9, "naïve façade — Ünïcode “quotes” 中文字符 🙂   tail"),
    (10, "%%% ### 12345 !!!"),
]
SCHEMA = "doc_id long, text string, ids string, n long, starts string, media string, sid string, found string"


def frame(spark, rows=None):
    """Documents with more columns, some of which are named like columns of the operators."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "s", "f") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
