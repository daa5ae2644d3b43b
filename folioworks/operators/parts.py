"""Ordered exports of any size: the lines of each group as numbered parts of bounded bytes, and a manifest that says where each lies.

The files of a group, one after another in order of their numbers, are the group's whole
export; a large part is a file, small ones share files.  No group is one row or one task:
lines are dealt by ranges of group and order, sums of the ranges give every range its
offset, running sums inside a range give every line its offset in its group, and the
offset tells its part.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.inputs import table
from ..sources.staging import kept, new_dir
from . import render
from .corpus import SQL_EMAILS

#: Bytes of a part, about; bytes of a file, or of a range of lines, that parts smaller than that share; most parts in a file.
PART_BYTES, FILE_BYTES, IN_FILE = 64 << 20, 8 << 20, 4096


def write_parts(lines: DataFrame, path: str, group: str, order: list[str], part_bytes: int = PART_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the column line of each group in order, a line break after each, and returns the manifest: group, file, part, offset, bytes, lines.

    A line belongs to the part that its first byte falls into, so a part has at most
    part_bytes and one line more.  As many parts in a row as fit file_bytes lie in one
    file, one after another (file_bytes 0: each has its own), in folders by group and
    file under path; offset is a part's place in its group's export.
    Rows that are equal in group and order stand in order of line.  Null lines are
    empty; a null group is a group of its own; an empty table gives no file and no row.
    """
    rows = lines.select(F.col(group).alias("group"), *order, F.coalesce("line", F.lit("")).alias("line"))
    rows = rows.withColumn("size", F.octet_length("line").cast("long") + 1)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    places = ["group", *order, "line"]
    tasks = max(1, -(-total // max(part_bytes, FILE_BYTES)))  # by bytes, however many parts they make
    ranged = kept(rows.repartitionByRange(tasks, *places).withColumn("range", F.spark_partition_id()), "ranges")
    # a row for each group and range: as many as there are ranges and groups
    sums = ranged.groupBy("group", "range").agg(F.sum("size").alias("held"))
    base = sums.select("group", "range", (F.sum("held").over(W.partitionBy("group").orderBy("range")) - F.col("held")).alias("base"))
    here = ranged.join(base.withColumnsRenamed({"group": "g", "range": "r"}), F.col("group").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r"))).drop("g", "r")
    within = W.partitionBy("range", "group").orderBy(*order, "line").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("base") + F.sum("size").over(within) - F.col("size")
    in_file = min(max(1, file_bytes // part_bytes), IN_FILE)
    part = F.floor(F.col("offset") / part_bytes)
    placed = kept(here.withColumn("offset", start).withColumns({"part": part, "file": F.floor(part / in_file)}), "placed")
    placed.repartition(tasks, "group", "file").sortWithinPartitions("group", "file", "offset").select("group", "file", "line").write.partitionBy("group", "file").text(path)
    return placed.groupBy("group", "file", "part").agg(F.min("offset").alias("offset"), F.sum("size").alias("bytes"), F.count("*").alias("lines")).withColumnRenamed("group", group)


def part_files(manifest: DataFrame, path: str, group: str) -> DataFrame:
    """The manifest, less the files' numbers, with the SHA-256 of each part's bytes as they lie in its file."""
    files = manifest.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.url_decode(F.regexp_extract("path", "group=([^/]*)/", 1)).alias("g"), F.regexp_extract("path", "file=([^/]*)/", 1).cast("long").alias("f"), "content")
    on = (F.coalesce(F.col(group).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) == F.col("g")) & (F.col("file") == F.col("f"))
    held = manifest.groupBy(group, "file").agg(F.collect_list(F.struct("part", "offset", "bytes", "lines")).alias("parts"), F.min("offset").alias("first"))
    place = lambda p: (p["offset"] - F.col("first") + 1).cast("int")
    hashed = lambda c: F.transform("parts", lambda p: F.struct(*(p[n].alias(n) for n in ("part", "offset", "bytes", "lines")), F.sha2(F.substring(c, place(p), p["bytes"].cast("int")), 256).alias("sha256")))
    once = F.transform(F.array("content"), hashed)  # one element: a row's bytes are fetched once for all its parts
    return held.join(named, on, "left").select(group, F.inline(F.element_at(once, 1)))


def _library(s, d) -> DataFrame:
    path = new_dir(s, "export")
    return part_files(write_parts(render.QUERIES["render_markdown"](s, d), path, "library", ["item_pos"], 3000), path, "library")


def _emails(s, d) -> DataFrame:
    found = table(s, d, "documents").select("source", F.explode(T.emails(F.col("text"))).alias("line")).distinct()
    path = new_dir(s, "emails")
    return part_files(write_parts(found, path, "source", [], 400), path, "source")


def _sql(rows: str, group: str, order: str, part_bytes: int) -> str:
    return f"""SELECT {group}, part, min(start) AS "offset", sum(size)::BIGINT AS bytes, count(*) AS lines, sha256(string_agg(line || chr(10), '' ORDER BY start)) AS sha256 FROM (
      SELECT *, (start // {part_bytes})::BIGINT AS part FROM (SELECT *, (sum(size) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM (SELECT *, strlen(line) + 1 AS size FROM ({rows})))) GROUP BY ALL"""


QUERIES = {"export_parts": _library, "email_parts": _emails}
SQL = {
    "export_parts": _sql(render.SQL["render_markdown"], "library", "item_pos", 3000),
    "email_parts": _sql(f"SELECT DISTINCT source, unnest({SQL_EMAILS}) AS line FROM documents", "source", "line", 400),
}
