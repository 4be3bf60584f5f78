"""A corpus pipeline of five of the training-data operators; each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisway.llm.common import read, shared_folder
from trellisway.llm.decontamination import decontaminated
from trellisway.llm.jaccard_join import one_of_each
from trellisway.llm.packing import packed, token_pieces
from trellisway.llm.substring_dedup import substring_dedup
from trellisway.llm.toxicity import score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from `labels` and these texts, doesn't reject. Null and empty texts have
    no evidence and stay unless most labels are toxic; repeated rows are judged alike; without labels all stay."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, prefix="_toxic_").where("_toxic_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id; of rows equal in id and text one. Null and
    wordless texts stay, one for each id."""
    return one_of_each(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a document that loses all its words goes, others stay, null and empty
    ones as they are. Every place of a repeated run is cut, also of rows equal in id and text."""
    out = substring_dedup(docs, prefix="_dedup_", new_text=True).where("_dedup_n_removed = 0 OR _dedup_n_removed < _dedup_n_words")
    changed = F.col("_dedup_n_removed") > 0
    new = {"text": F.when(changed, F.col("_dedup_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("_dedup_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null, empty and short texts stay; rows that share an id are told
    apart by their texts; an empty benchmark drops nothing."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens. A null text is empty and has the end token
    alone; repeated rows are packed each; equal lengths are placed in the order of id, piece and checksum."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packed(pieces, 2048).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The learned model and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
