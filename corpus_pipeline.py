"""From documents to token ids: quality, near-duplicates, test items, SentencePiece.

Each stage works on all that the one before kept, and is written as Parquet and read again. All but the last return the
columns of documents; rows with a null id can't be told apart from others and are never dropped as near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import common, decontaminate, order_minhash, pu_quality, sentencepieces


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs hasn't."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; all where there is nothing to learn from."""
    model = pu_quality.train(docs, common.table(spark, sf_dir, "labels"))
    score = fresh("_score", docs)
    scored = pu_quality.with_scores(docs, model, score)
    return scored.where(F.col(score) >= (pu_quality.ACCEPT if model else 0)).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates; of rows that share an id, that with the smallest
    digest of its text, and of equal texts that with the smallest hash of the row."""
    classes = common.stash(order_minhash.near_duplicates(docs), "document-classes")
    gone = common.stash(classes.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    kept = order_minhash.only(docs, gone, "left_anti")
    if not classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        row, order = F.struct(*docs.columns), F.struct(F.md5(F.encode("text", "UTF-8")), F.xxhash64(*docs.columns))
        named = kept.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
        kept = named.unionByName(kept.where("doc_id IS NULL"))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    hits = fresh("_hits", docs)
    return decontaminate.with_hits(docs, common.table(spark, sf_dir, "benchmark"), hits).where(F.size(hits) == 0).drop(hits)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, how many, and the checks of the round trip."""
    import public_tokenizers

    out = sentencepieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids", "ids_crc32", "decoded_ok", "parity")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding", sentencepiece)]

#: No SQL fits a classifier, aligns words or knows the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
