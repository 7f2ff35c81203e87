"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but the last return
the columns of documents:

1. language_id: documents without a recognised language go.
2. near_dedup: one document of each class of near copies (five-word shingles, similarity 0.8 or more) stays.
3. passage_dedup: passages of 50 bytes and more that an earlier document holds are cut out of texts.
4. mix_sources: rows are sorted into a stream in which each source has its target weight.
5. packing: stretches of that stream, in its order, are packed into sequences of 4096 tokens; sequence_id grows along it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import language, minhash, mixing, packing, suffix
from siftstone.llm.common import forget, scratch, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, words=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs, length=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def stream_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in the order they were written in, over partitions too: by number of the part file, then by row.

    A reader deals files (or pieces of them) to partitions by size. What wasn't read from Parquet keeps its own order.
    """
    try:
        at = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.select("doc_id", "text")
    # Numbers are padded to a fixed width only up to 99999 (parts) and 999 (files of a part).
    part, file = (F.coalesce(F.regexp_extract("__file", p, 1).try_cast("bigint"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    return at.orderBy(part, file, "__file", "__row").select("doc_id", "text")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(stream_order(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mix_sources", mix_sources), ("packing", pack_tokens)]

#: SQL can't train a language model or run a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again for the next, and then deleted.

    What the last stage reads stays until the application ends, as its result is lazy.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            done = written(stage(spark, docs, sf_dir), name)
            made[:] = [t for t in made if t is not done]
        forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
