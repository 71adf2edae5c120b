"""Queries over texts. Only p9_found can be put in SQL; the others are tested against brute force, another encoder, and held-out texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import containment, encode, residue

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text", f"{encode.TOKENIZERS}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return containment.leaks(table(spark, d, "documents"), table(spark, d, "test_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p8_ids, p9_found, p10_found)}


#: DuckDB has no NFKC; NFC gives the same words but for letters in other forms (ligatures, full width), which tests cover.
_WORDS = r"regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+')"
P9 = f"""
WITH docs AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id AS id, {_WORDS} AS w FROM test_items WHERE text IS NOT NULL),
d AS (SELECT id, array_to_string(w[i:i+11], ' ') AS run FROM docs, unnest(range(1, greatest(len(w) - 10, 1))) AS t(i)),
x AS (SELECT DISTINCT id, array_to_string(w[i:i+11], ' ') AS run FROM items, unnest(range(1, greatest(len(w) - 10, 1))) AS t(i))
SELECT DISTINCT d.id AS doc_id, x.id AS item_id FROM d JOIN x USING (run)
"""


def oracle_sql() -> dict[str, str]:
    return {"p9_found": P9}
