"""The corpus pipeline: documents to token ids, each stage by one operator of terrafacet.llm.

A stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
All but the last return the columns of documents: doc_id, text, lang, source,
n_chars. run() writes each stage's result in the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafacet.llm import bpe, kneser_ney, langid, mixing, near_dedup
from terrafacet.llm.queries import BYTE_BPE
from terrafacet.llm.shared import stored
from terrafacet.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MOST_PASSES = 1.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised, under the recognised language."""
    model = langid.train(docs, F.lit(True))
    found = langid.predict(docs, model, *COLUMNS)
    return found.where("accepted").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose perplexity is within their language's threshold; trusted are those labelled as good."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(docs, trusted, *COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose shingle sets are alike to 80 percent or more."""
    return near_dedup.keep_one(docs.select(*COLUMNS), 80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, sources tempered until none is passed over more than MOST_PASSES times."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS), mixing.text_tokens(), repetition=MOST_PASSES)
    return mixed.select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row by byte-level BPE."""
    return bpe.encode_documents(docs, BYTE_BPE).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing_sources", mixing_sources),
    ("token_ids", token_ids),
]
ORACLE_SQL = None  # trained models and tokenizers aren't SQL; tests hold every stage against a plainer form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
