"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import op2_byte_bpe
from tessera.llm.decontaminate import op7_decontamination
from tessera.llm.html import op3_html_extraction
from tessera.llm.jpeg import op9_media_columns
from tessera.llm.langid import op5_language_id
from tessera.llm.licenses import op4_license_scan
from tessera.llm.licenses import oracle as license_oracle
from tessera.llm.minhash import op8_minhash_dedup
from tessera.llm.minhash import oracle as minhash_oracle
from tessera.llm.records import op1_token_records
from tessera.llm.secrets import op10_secret_scan
from tessera.llm.secrets import oracle as secret_oracle
from tessera.llm.suffix import op6_suffix_dedup
from tessera.llm.suffix import oracle as suffix_oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_extraction": op3_html_extraction,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_secret_scan": op10_secret_scan,
}
ORACLES: dict[str, str] = {
    "op4_license_scan": license_oracle(),
    "op6_suffix_dedup": suffix_oracle(),
    "op8_minhash_dedup": minhash_oracle(),
    "op10_secret_scan": secret_oracle(),
}
