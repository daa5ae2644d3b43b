"""A folder of files matched to a bibliography: a file that cannot be read is a row with its reason, never the end of the job."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import helpers, markup
from ..plans.inputs import table
from ..sources.files import described
from ..sources.staging import kept, new_dir
from .matching import THRESHOLD, match_files

#: Bytes of the largest file that is read (Spark holds a file in one cell), characters of a reason that are kept.
MOST_BYTES, REASON = 1 << 30, 200


def plain_text(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1251", "replace")


def html_text(content: bytes) -> str:
    return "\n".join(text for _, _, text in helpers.page_blocks(plain_text(content)))


def latex_text(content: bytes) -> str:
    rows, _ = markup.latex_tree(plain_text(content))
    return "\n".join(r[markup.COLUMNS.index("text")] for r in rows if r[markup.COLUMNS.index("kind")] in ("heading", "paragraph", "list_item", "cell"))


#: Readers by format; other formats have none.
READERS: dict[str, Callable[[bytes], str]] = {"txt": plain_text, "markdown": plain_text, "html": html_text, "latex": latex_text}


def read_texts(readers: dict[str, Callable[[bytes], str]]) -> Callable[[Column, Column], Column]:
    """A column function of content and format: a struct of text and error, one of which is null; whatever a reader raises is that row's error."""

    @F.pandas_udf("text string, error string")
    def run(content: pd.Series, form: pd.Series) -> pd.DataFrame:
        rows = []
        for c, f in zip(content, form, strict=True):
            try:
                rows.append((readers[f](bytes(c)), None) if f in readers else (None, f"no reader for {f}"))
            except Exception as wrong:  # noqa: BLE001  a reader's error is a result here
                rows.append((None, f"{type(wrong).__name__}: {wrong}"[:REASON]))
        return pd.DataFrame(rows, columns=["text", "error"])

    return run


def read_folder(spark: SparkSession, root: str, exts: list[str] | None = None, readers: dict[str, Callable[[bytes], str]] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, name, ext, format, size, text, error of every file below root (with the extensions): text or error is null.

    The inventory is listed without contents.  Contents are read apart, so that a file
    that goes or breaks meanwhile leaves no row there; joined back, it is a file that
    cannot be read.  Files that are too large, and formats without a reader, are not
    opened; files without a byte are in no scan of Spark's, so they have no row.
    """
    readers = READERS if readers is None else readers
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    listed = described(scan.load(root).select("path", F.col("length").alias("size")))
    listed = listed if exts is None else listed.where(F.col("ext").isin(exts))
    listed = kept(listed.select("path", "name", "ext", "format", "size"), "inventory")
    wanted = described(scan.load(root).where(F.col("length") <= most_bytes)).where(F.col("format").isin(*readers))
    wanted = wanted if exts is None else wanted.where(F.col("ext").isin(exts))
    texts = wanted.select("path", read_texts(readers)("content", "format").alias("r")).select("path", "r.text", "r.error")
    reason = F.when(~F.col("format").isin(*readers), F.concat(F.lit("no reader for "), "format")).when(F.col("size") > most_bytes, "too large").otherwise("cannot be read")
    both = listed.join(texts, "path", "left")
    return both.withColumn("error", F.when(F.col("text").isNull(), F.coalesce("error", reason)))


def match_folder(spark: SparkSession, root: str, bib: DataFrame, mapping: DataFrame | None = None, threshold: float = THRESHOLD, fuzzy: bool = True, **how) -> DataFrame:
    """path, name, item_pos, score, matched, error of every file of a folder: those that cannot be read are unmatched rows with their reason."""
    files = kept(read_folder(spark, root, **how), "folder")
    docs = files.where("error is null").select(F.col("path").alias("doc_id"), "text", F.col("name").alias("filename"))
    found = match_files(docs, bib, mapping, threshold, fuzzy).withColumnRenamed("doc_id", "path")
    rows = files.select("path", "name", "error").join(found, "path", "left")
    return rows.select("path", "name", "item_pos", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matched", F.lit(False)).alias("matched"), "error")


#: Documents in a file that a query derives; every fifth of these files is of a format without a reader.
IN_FILE = 200


def _written(s: SparkSession, d: str) -> str:
    path = new_dir(s, "folder")
    run = F.floor(F.col("doc_id") / IN_FILE)
    docs = table(s, d, "documents").select("doc_id", "text", run.alias("run"), F.when(run % 5 == 4, "pdf").otherwise("txt").alias("kind"))
    for kind, how in (("txt", {}), ("pdf", {"compression": "gzip"})):
        # a folder for each kind, as a second column of the partitioning makes the writer sort by both and forget doc_id
        rows = docs.where(F.col("kind") == kind).repartition("run").sortWithinPartitions("run", "doc_id")
        rows.select("run", "text").write.options(**how).partitionBy("run").text(f"{path}/kind={kind}")
    return path


QUERIES = {
    "read_folder": lambda s, d: read_folder(s, _written(s, d), ["txt", "gz"]).select(F.regexp_extract("path", "run=([0-9]+)", 1).cast("long").alias("run"), F.sha2("text", 256).alias("text_sha256"), "error"),
}
SQL = {
    "read_folder": f"""SELECT run, CASE WHEN run % 5 <> 4 THEN sha256(t) END AS text_sha256, CASE WHEN run % 5 = 4 THEN 'no reader for unknown' END AS error
      FROM (SELECT doc_id // {IN_FILE} AS run, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)""",
}
