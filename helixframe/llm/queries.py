"""The registered queries of the corpus operators, with their production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid, matroska, packing, piece_fst, sharding, simhash, substring, token_orc, urlfilter, vptree
from helixframe.storage import new_path, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


# The rules of the page filter.
RULES = [
    urlfilter.Rule("allow", "org/"),
    urlfilter.Rule("block", "example.org/es/"),
    urlfilter.Rule("block", "example.org/en/1"),
    urlfilter.Rule("allow", "com/fr/"),
    urlfilter.Rule("block", "com/de/"),
]


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urlfilter.parsed(table(spark, sf_dir, "pages"), RULES)
    return urlfilter.judge(pages, RULES, urlfilter.fit(urlfilter.labelled(pages, RULES)))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "removed")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), tau=3, shingle=3)


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_orc.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_orc.digest(token_orc.read(spark, path))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    back = matroska.read_back(matroska.store(docs.select("doc_id", n_bytes, "text")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_fst.decode(piece_fst.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.crc32("ids").alias("ids_crc32"), F.crc32("decoded").alias("decoded_crc32"), F.coalesce(F.col("decoded") == F.col("text"), F.lit(False)).alias("same"))


#: Branches are pruned only where no neighbour can be: a larger factor loses some where vectors have few intrinsic dimensions.
RELAX = 1.0


def op10_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vptree.usable(table(spark, sf_dir, "embeddings"))
    return vptree.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20, relax=RELAX)


QUERIES = {f.__name__: f for f in (op1_packing, op2_urlfilter, op3_substring, op4_sharding, op5_langid, op6_simhash, op7_token_orc, op8_matroska, op9_piece_fst, op10_vptree)}
ORACLES = {"op4_sharding": sharding.oracle()}
