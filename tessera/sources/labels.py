"""Label files: one box a line, class and normalised centre, width and height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.paths import file_name, stem_of

#: Line ends as text readers know them.
LINE = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def parse_lines(lines: DataFrame, mode: str = "permissive", line: str = "line") -> DataFrame:
    """lines with cls, cx, cy, bw, bh. Lines of fewer than five tokens are passed over, further tokens are not read.

    The class is cut to a whole number. A token that isn't a number raises in mode "strict"; in mode
    "permissive" its line is passed over.
    """
    tokens = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    t = lines.withColumn("_t", tokens).where(F.size("_t") >= 5)
    number = lambda k: (F.col("_t")[k].cast("double") if mode == "strict" else F.col("_t")[k].try_cast("double"))
    t = t.withColumns({name: number(k) for k, name in enumerate(("_c", "cx", "cy", "bw", "bh"))})
    if mode != "strict":
        ok: Column = F.lit(True)
        for c in ("_c", "cx", "cy", "bw", "bh"):
            ok = ok & F.col(c).isNotNull()
        t = t.where(ok)
    # A cast to a whole number truncates toward zero.
    return t.withColumn("cls", F.col("_c").cast("int")).drop("_t", "_c")


def parse_text(texts: DataFrame, mode: str = "permissive", text: str = "text") -> DataFrame:
    """Rows of whole label files → rows of boxes, with `line_no` from 0 over all lines of the file."""
    lines = texts.select(*(c for c in texts.columns if c != text), F.posexplode(F.split(text, LINE)).alias("line_no", "line"))
    return parse_lines(lines, mode).drop("line")


def read_labels(spark: SparkSession, folder: str, dataset_id: str = "", mode: str = "permissive") -> DataFrame:
    """(dataset_id, stem, line_no, cls, cx, cy, bw, bh) of all .txt files right in a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
    texts = files.select(F.lit(dataset_id).alias("dataset_id"), stem_of(file_name(F.col("_metadata.file_path"))).alias("stem"), F.col("value").alias("text"))
    return parse_text(texts, mode)
