"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

A document is told by its doc_id and its text, so texts that share an id, also a missing
one, are judged one by one.  Every stage ignores further columns, whatever their names,
works on whole texts, and gives an empty result for an empty table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import new_dir
from folioworks.llm.decontam import find_leaks
from folioworks.llm.language import with_language
from folioworks.llm.minhash import near_duplicates
from folioworks.llm.packing import pack_documents
from folioworks.llm.quality import score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, dropped: DataFrame, mark: Column) -> DataFrame:
    """docs less the rows whose doc_id and mark (of the text) are among the dropped (doc_id, mark)."""
    gone = dropped.toDF("gone_id", "gone_mark").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    return docs.select(*COLUMNS, mark.alias("mark")).join(gone, same, "left_anti").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected.

    Those are texts that are null, empty or without a letter, and texts far from every
    language learned; with nothing to learn from, all.  Equal texts, whatever their ids,
    stay or go alike; repeated rows and null ids stay as they come; a null lang only
    means that the row teaches nothing.
    """
    return with_language(docs.select(*COLUMNS)).where("not language.rejected").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be of low quality.

    The score depends on the text alone: null and empty texts have that of an empty one;
    equal texts and repeated rows stay or go alike, also those without an id.  A score at
    the threshold stays; without labels all stay.
    """
    poor = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0")
    return _without(docs, poor.select("doc_id", "text_hash"), F.xxhash64("text"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that with the least id.

    Null texts and rows without an id are not compared and stay; empty texts are equal
    texts.  Different texts of one id are compared like any others.  Of rows with one id
    and one text one stays, that with the least lang, source and n_chars (nulls first).
    """
    kept = _without(docs, near_duplicates(docs).where("not kept").select("doc_id", "text_key"), F.md5("text"))
    rows = docs.where("doc_id is not null and text is not null").groupBy("doc_id", F.md5("text")).count()
    if rows.where("count > 1").isEmpty():  # then the grouping below would change nothing
        return kept
    named = kept.where("doc_id is not null and text is not null")
    least = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    once = named.groupBy("doc_id", F.md5("text")).agg(F.first("text").alias("text"), least).select("doc_id", "text", "rest.*")
    return once.select(*COLUMNS).unionByName(kept.where("doc_id is null or text is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item.

    Documents without an id are looked at like others; null and empty texts leak nothing
    and stay; equal texts and repeated rows stay or go alike.  With no benchmark all stay.
    """
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, leaks.select("doc_id", "text_hash"), F.xxhash64("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row per piece.

    A null or empty text is its end id alone; repeated rows and null ids are packed as
    often as they come; a text of more than 2048 tokens is cut into several pieces.
    """
    import public_tokenizers

    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language_stage), ("quality", quality_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL cannot express the classifiers or the packing; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of sf_dir that every stage kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
