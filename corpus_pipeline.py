"""Corpus preparation: five stages over ``documents``, each written as Parquet and
read again as the next one's documents.

1. language ID: documents whose language is rejected go;
2. exact dedup: of equal texts the row with the largest id stays;
3. SimHash near-dedup: of each component of fingerprints the smallest id stays;
4. mixing: sources are repeated or cut to their target weights, in training order;
5. byte-level BPE: token ids, their count and digests.

Stages 1-4 return the columns of their input.  Stage functions take (spark, docs,
sf_dir); ``sf_dir`` is not read again, each stage works on all that the one
before it kept.  Nulls, repeated rows, empty tables and extra columns are
treated as each operator's docstring says.  ``text`` must be there; if ``lang``
is null everywhere nothing can be learned and stage 1 rejects everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolex.llm.common import cut, table
from geolex.llm.op1_simhash_near_dedup import RADIUS, SHINGLE, drop_near_copies
from geolex.llm.op2_mix_sources import mix
from geolex.llm.op3_exact_dedup import drop_copies
from geolex.llm.op5_language_id import drop_rejected
from geolex.llm.op9_byte_bpe import encoded_digests


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, shingle=SHINGLE, radius=RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded_digests(docs, keep_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_bytes),
]

#: Compression, SimHash and BPE have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
