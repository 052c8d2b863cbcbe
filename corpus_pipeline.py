"""Corpus cleaning: documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; the driver
writes its result as Parquet and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm import packing, pu_quality, quality_rules, simhash, textio

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts (score of at least 0.5, ties at 0.5 included).

    Null and empty texts are scored as texts without bytes; texts of any length are scored whole; repeated rows stay
    repeated; without labels every score is 0.5 and all stay; an empty table stays empty; columns that are not those of
    documents are not read, whatever their names."""
    docs = docs.select(*COLUMNS)
    model = pu_quality.train(docs, textio.table(spark, sf_dir, "labels"))
    return pu_quality.score(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band, limits included.

    Null and empty texts have no words and go; texts of any length are read whole; a null language is one of its own;
    repeated rows stay repeated; an empty table stays empty; other columns are not read, whatever their names."""
    docs = docs.select(*COLUMNS)
    model = quality_rules.fit(docs)
    measured = textio.cut(quality_rules.measure(docs, model, COLUMNS))
    return quality_rules.verdict(measured, quality_rules.bands(measured)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id. Of rows that repeat its id those in the
    same component go too, but for the least text; rows without an id name no component, and one of each text stays.

    Null and empty texts are one component, as both have no words; texts of any length are read whole; of equal rows
    one stays; an empty table stays empty; other columns are not read, whatever their names."""
    docs = docs.select(*COLUMNS)
    members = textio.cut(simhash.near_duplicates(docs.select("doc_id", "text")))
    # Ids that name their component; those of several rows, where some texts may belong to other components.
    fate = members.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("names"), (F.count("*") > 1).alias("several")).where("names")
    named = docs.join(fate.select("doc_id", "several"), "doc_id")
    repeated = named.where("several").withColumn("mark", F.xxhash64("doc_id", "text"))
    fps = simhash.fingerprint_table(repeated.select(F.col("mark").alias("doc_id"), "text")).select(F.col("doc_id").alias("mark"), "fp").dropDuplicates(["mark"])
    roots = members.where("doc_id = component_id").select("doc_id", "fp", "root").distinct()
    first = Window.partitionBy("doc_id", "root").orderBy("text", "lang", "source", "n_chars")
    one = repeated.join(fps, "mark").join(roots, ["doc_id", "fp"]).withColumn("place", F.row_number().over(first)).where("place = 1")
    return named.where("NOT several").select(*COLUMNS).unionByName(one.select(*COLUMNS)).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens.

    Null and empty texts are the end token alone; texts of any length are cut, none dropped; repeated rows and ids are
    documents of their own; ties in length go in order of arrival; an empty table gives no rows; other columns are not
    read, whatever their names."""
    return packing.pack(docs, packing.word_encoder(textio.tokenizer_path(textio.WORD_TOKENIZER), most=packing.LEXICON_BESIDE))


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("near-duplicates", near_duplicates), ("packing", pack)]

#: The classifier, the perplexity bands and best-fit packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = textio.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = textio.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
