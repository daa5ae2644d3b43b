"""Files to tables: scans, inventories, decoding."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import helpers
from ..plans.inputs import derived, plain, table
from .staging import new_dir

#: Formats by extension, extensions that are read unless others are asked for.
FORMATS = {"pdf": "pdf", "docx": "docx", "djvu": "djvu", "txt": "txt", "md": "markdown", "tex": "latex", "html": "html"}
DEFAULT = ["pdf", "docx", "djvu", "txt"]


def described(files: DataFrame) -> DataFrame:
    """Adds name, ext (lower case) and format of path."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.coalesce(*(F.when(ext == e, f) for e, f in FORMATS.items()), F.lit("unknown"))
    return files.withColumns({"name": name, "ext": ext, "format": known})


def ingest_files(spark: SparkSession, root: str, exts: list[str] | None = None) -> DataFrame:
    """path, name, ext, format, size, sha256, content of all files below root with the extensions, whatever their case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return described(found).where(F.col("ext").isin(exts or DEFAULT)).select("path", "name", "ext", "format", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def list_files(spark: SparkSession, root: str, exts: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, name, ext, size without reading contents; only direct children unless recursive."""
    found = described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length"))
    found = found if exts is None else found.where(F.col("ext").isin(exts))
    if not recursive:
        found = found.where(~F.substring_index("path", root.rstrip("/").split("://")[-1] + "/", -1).contains("/"))
    return found.select("path", "name", "ext", F.col("length").alias("size"))


def decode_text(content: Column, mode: str = "fallback") -> Column:
    """UTF-8 bytes as text; others as Windows-1251 (fallback) or without their invalid bytes (ignore). Only those rows leave the JVM."""
    other = (helpers.decode_1251 if mode == "fallback" else helpers.decode_dropping)(F.when(~F.is_valid_utf8(content.cast("string")), content))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(other)


#: Documents in a file that a query derives.
IN_FILE = 500


def _written(s, d) -> str:
    """The documents as text files, one for each source and run of IN_FILE ids, so that no file grows with the table."""
    path = new_dir(s, "files")
    docs = table(s, d, "documents").select("source", "doc_id", "text", F.floor(F.col("doc_id") / IN_FILE).alias("run"))
    docs.repartition("source", "run").sortWithinPartitions("source", "run", "doc_id").select("source", "run", "text").write.partitionBy("source", "run").text(path)
    return path


BYTES = "SELECT doc_id, CAST(text AS BINARY) AS content FROM {documents} UNION ALL SELECT -1 - doc_id, X'F2E5F1F2' FROM {documents}"


def _source_of(path: str = "path") -> Column:
    return F.regexp_extract(path, "source=([^/]*)/", 1)


def _ignored(s, d):
    rows = derived(s, d, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(X'61FF62', CAST(text AS BINARY)) ELSE CAST(text AS BINARY) END AS content FROM {documents}", "documents")
    return rows.select("doc_id", decode_text(F.col("content"), "ignore").alias("text"))


QUERIES = {
    "ingest_files": lambda s, d: ingest_files(s, _written(s, d)).select(_source_of().alias("source"), "ext", "format", "size", "sha256"),
    "list_files": lambda s, d: list_files(s, _written(s, d), ["txt"]).groupBy(_source_of().alias("source"), "ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")),
    "decode_text": lambda s, d: derived(s, d, BYTES, "documents").select("doc_id", decode_text(F.col("content")).alias("text")),
    "decode_text_ignore": _ignored,
}
SQL = {
    "ingest_files": f"SELECT source, 'txt' AS ext, 'txt' AS format, strlen(t)::BIGINT AS size, sha256(t) AS sha256 FROM (SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source, doc_id // {IN_FILE})",
    "list_files": f"SELECT source, 'txt' AS ext, count(DISTINCT doc_id // {IN_FILE}) AS files, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source",
    "decode_text": "SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, 'тест' FROM documents",
    "decode_text_ignore": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ab' || text ELSE text END AS text FROM documents",
}
