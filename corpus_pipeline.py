"""Corpus pipeline: documents to packed sequences.

Each stage gets what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, near_dups, packing, quality, repeats
from brindle.llm.common import checkpointed, discard, fresh, scope, scratch, spread, table
from brindle.llm.queries import WINDOW, tokenizer_path

#: Some stages can't be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts, and very long ones, are scored as any other; repeated rows have one score each, so all of them stay or go. Without labels every
    document stays. An empty table stays empty; columns of any name are kept.
    """
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs, "_score"), fresh(docs, "_predicted")
    scored = quality.score_documents(docs, model, score_col=score, predicted_col=predicted)
    return scored.filter(F.col(predicted) == 1).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that of the least id.

    Repeated rows of it count as one, and so do rows of its id that are in the class too; of these the one with the least hash of its text
    stays. Rows without an id can't be told apart and stay.
    """
    found = near_dups.similar_documents(docs).filter("doc_id is not null").select("doc_id", "text_hash", "class_node", "class_id")
    found = checkpointed(found)
    id_, hash_ = fresh(docs, "_id"), fresh(docs, "_hash")
    gone = found.filter("doc_id != class_id").select("doc_id", "text_hash")
    # rows of the least id itself, which are several only where ids repeat
    heads = found.filter("doc_id = class_id")
    several = checkpointed(heads.groupBy("class_node").agg(F.min("text_hash").alias("kept"), F.count("*").alias("n")).filter("n > 1"))
    repeats_ids = not several.isEmpty()
    if repeats_ids:
        gone = gone.unionByName(heads.join(several, "class_node").filter("text_hash != kept").select("doc_id", "text_hash"))
    of = gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    left = docs.join(of, (docs["doc_id"] == of[id_]) & (F.xxhash64(docs["text"]) == of[hash_]), "left_anti")
    if not repeats_ids:
        return left
    # rows that repeat as a whole text of one id: one of each stays
    named = left.filter("doc_id is not null").withColumn(hash_, F.xxhash64("text"))
    return named.dropDuplicates(["doc_id", hash_]).drop(hash_).unionByName(left.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one has too.

    The earliest is that of the least id, nulls last; of rows alike in that, copies of a text lose it all but once. Null and empty texts have nothing to lose and stay; a text
    of any length is cut whole. Rows, columns of any name among them, stay; n_chars follows the text. An empty table stays empty.
    """
    removed = fresh(docs, "_removed")
    shortened = repeats.remove_repeats(docs, passage_words=repeats.PASSAGE_WORDS, spans_col=removed).drop(removed)
    return shortened.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own, and comes last. Texts without words, null ones among them, are taken as their source's others are; a long text counts by all its words. Repeated
    rows are documents of their own, ties of keys go by id. Columns of any name are kept; an empty table stays empty.
    """
    return mixing.take_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences.

    A null or empty text is its closing id alone; a text of more than a sequence is cut into pieces. Repeated rows are packed each; other columns are left out. An empty table
    gives no rows.
    """
    pieces = packing.tokenize_documents(docs, tokenizer_path(), WINDOW)
    packed = packing.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), WINDOW)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what they return is written to the shared folder.

    What a stage has written for itself goes when its result is there, and so does the result before it: only the last remains.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = scratch(spark, "corpus")
        with scope():
            stage(spark, spread(docs), sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            discard(spark, before)
        before = folder
    return docs
