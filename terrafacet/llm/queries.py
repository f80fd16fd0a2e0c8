"""The queries opN_<name>: each applies its operator to a whole table and derives the result columns."""

from __future__ import annotations

import zlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafacet.llm import ball_trees, bpe, fixity, hnsw, kneser_ney, langid, lexical, media, mixing, near_dedup, quoting, simple8b, token_counts
from terrafacet.llm.shared import shared_path, stored
from terrafacet.session import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MIX_ENTROPY = 0.98
BEST, TOKEN_LIMIT = 50, 512
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as 8-bit sound under a general type, sniff the stored bytes and read the samples back."""
    blobs = stored(media.texts_to_media(table(spark, sf_dir, "documents")), "op1-media")
    known = blobs.select("doc_id", "declared", "content", F.length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256"))
    read = media.sound_features(known)
    return read.select(
        "doc_id",
        F.expr("cast(octet_length(rtrim(X'FF', payload)) as long)").alias("n_bytes"),  # UTF-8 has no byte 255
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "sniffed",
        "corrected",
        F.size("found").alias("n_found"),
    )


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as Simple-8b blocks, read them back, and say where each document's ids lie."""
    path = shared_path(spark, "op2-blocks")
    simple8b.write_blocks(table(spark, sf_dir, "documents"), WORD_BPE, 1, path)
    return simple8b.map_documents(
        simple8b.read_blocks(spark, path),
        lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
        ["doc_id", "start", "n_tokens", "ids_crc32"],
        [pa.int64()] * 4,
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the two thirds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, F.col("doc_id").isNotNull() & ~held_out())
    return langid.predict(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as often as temperature mixing takes them, as many tokens as there are, at 0.98 of the largest entropy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), mixing.text_tokens().alias("tokens"))
    return mixing.mix_sources(counted, F.col("tokens"), entropy=MIX_ENTROPY)


def op5_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike to 85 percent."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail, each message quoting the two before it, and linked back to threads without quotes."""
    return quoting.link_replies(quoting.as_mail(table(spark, sf_dir, "conversations")))


def op7_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document and decode its ids; digests of both."""
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE, decode=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages stored as WARC records against a damaged stored replica: every record that differs, by the bytes read back."""
    records = stored(fixity.page_records(table(spark, sf_dir, "pages")), "op8-first")
    found = fixity.audit(records, stored(fixity.damaged(records), "op8-second"))
    return found.select("file", "ordinal", "kind", *(f"{side}_{c}" for side in ("first", "second") for c in ("start", "length", "digest")))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of those labelled as good, and whether its language's threshold keeps it."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of 16 centroids over all vectors of 64 components, as integers."""
    return ball_trees.cluster(table(spark, sf_dir, "embeddings"))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BEST)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, TOKEN_LIMIT)


QUERIES = {
    "op1_signature_sniffing": op1_signature_sniffing,
    "op2_simple8b": op2_simple8b,
    "op3_language_id": op3_language_id,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_odd_sketch_dedup": op5_odd_sketch_dedup,
    "op6_quotation_linking": op6_quotation_linking,
    "op7_rank_array_bpe": op7_rank_array_bpe,
    "op8_merkle_audit": op8_merkle_audit,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_hnsw": op10_hnsw,
    "op11_ball_tree_clusters": op11_ball_tree_clusters,
    "op12_bit_sliced_search": op12_bit_sliced_search,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {
    "op4_temperature_mixing": mixing.oracle(MIX_ENTROPY),
    "op6_quotation_linking": quoting.ORACLE,
    "op8_merkle_audit": fixity.ORACLE,
    "op11_ball_tree_clusters": ball_trees.oracle(),
    "op12_bit_sliced_search": lexical.oracle(BEST),
}
