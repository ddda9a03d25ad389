"""The training-text pipeline: documents in, packed token sequences out.

``STAGES`` are applied in order. Each works on all rows the one before it kept, its result is
written as Parquet in the shared folder and read again as the next one's documents. All but the
last return the columns of documents (doc_id, text, lang, source, n_chars):

1. ``quality``        documents that the quality classifier rejects go;
2. ``near_duplicates`` of the documents linked by n-gram Jaccard similarity one stays, the one with
                      the smallest doc_id; rows that repeat an id stay together;
3. ``substrings``     words of long passages that a smaller doc_id also holds are cut out, n_chars is
                      counted anew, and documents with nothing left go;
4. ``mixing``         documents are sampled by probabilities raked to source, language and topic;
5. ``packing``        the tokens of what is left are packed into sequences (one row a piece).

Null texts are empty texts to every stage. Rows without an id are judged by quality, never
linked or cut, drawn by their text, and packed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.jaccard import near_duplicates
from assetlane.llm.mixing import mix_sources, with_form
from assetlane.llm.packing import pack
from assetlane.llm.quality_mil import quality_scores
from assetlane.llm.queries import TARGETS, TOKENIZERS
from assetlane.llm.substring import repeated_spans, remove_spans
from assetlane.llm.tables import if_small, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: the part of all tokens that mixing samples
SHARE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 7 accepts; labels come from ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(spark, docs, labels, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of operator 9, and all rows without an id."""
    found = near_duplicates(spark, docs).where("doc_id <> component_id").select("doc_id").distinct()
    copies = store(spark, found, "copies")
    return docs.join(if_small(copies, 8), "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that operator 5 removes."""
    cut = remove_spans(docs, repeated_spans(spark, docs), carry=["lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    return cut.where("n_removed = 0 OR n_removed < n_words").withColumn(
        "n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 3 samples."""
    mixed = mix_sources(spark, with_form(docs), TARGETS, SHARE)
    return mixed.where("sampled").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of operator 6."""
    return pack(docs, os.path.join(TOKENIZERS, "word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates_stage), ("substrings", substrings),
          ("mixing", mixing), ("packing", packing)]
#: models, raking and the tokenizer have no SQL form; tests compare the operators, but no test calls run()
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = store(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
