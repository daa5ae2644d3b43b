"""Source and target corpora compared document by document, and the gates that decide what is published."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import helpers
from ..plans.inputs import derived, plain, table

#: What an accepted pair of page images has at least, and at most.
LEAST_SIMILARITY, MOST_HASH_DISTANCE, LEAST_OVERLAP = 0.90, 20, 0.30


def inspect_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, metric, value: structural counts of block rows (doc_id, pos, kind, text)."""
    is_kind = lambda k: F.count_if(F.col("kind") == k)
    wide = blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), is_kind("heading").alias("headings"), is_kind("paragraph").alias("paragraphs"), is_kind("list_item").alias("list_items"),
        F.sum(F.length("text")).cast("long").alias("characters"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).cast("long").alias("runs"), F.count_if(F.col("text").rlike("https?://")).alias("links"),
    )
    return wide.unpivot("doc_id", [c for c in wide.columns if c != "doc_id"], "metric", "value")


def compare_metrics(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target value and ratio of each metric; lost if the target has less."""
    both = source.withColumnRenamed("value", "a").join(target.withColumnRenamed("value", "b"), ["doc_id", "metric"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.select("doc_id", "metric", a.alias("source"), b.alias("target"), F.coalesce(F.try_divide(b, a), F.lit(1.0)).alias("ratio"), (b < a).alias("lost"))


def page_geometry(source: DataFrame, target: DataFrame) -> DataFrame:
    """Greatest and root mean square errors of sizes and margins of pages (doc_id, page, width, height, margins: left, top, right, bottom).

    A page's error of size is the greater of its width's and height's; each margin counts
    by itself.  Errors are null where no page is on both sides; available: both sides
    have pages; complete: they have the same ones.
    """
    both = source.join(target.select("doc_id", "page", F.col("width").alias("w"), F.col("height").alias("h"), F.col("margins").alias("m")), ["doc_id", "page"], "full")
    size = F.greatest(F.abs(F.col("width") - F.col("w")), F.abs(F.col("height") - F.col("h")))
    seen = F.col("width").isNotNull() & F.col("w").isNotNull()
    margins = F.zip_with("margins", "m", lambda x, y: F.abs(x - y))
    squares = F.aggregate(margins, F.lit(0.0), lambda acc, x: acc + x * x)
    page = both.select("doc_id", "width", "w", seen.alias("seen"), F.when(seen, size).alias("e"), F.when(seen, F.array_max(margins)).alias("worst"), F.when(seen, squares).alias("squares"), F.when(seen, F.size(margins)).alias("n"))
    return page.groupBy("doc_id").agg(
        F.max("e").alias("max_error"),
        F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rms_error"),
        F.max("worst").alias("max_margin_error"),
        F.round(F.sqrt(F.try_divide(F.sum("squares"), F.sum("n"))), 6).alias("rms_margin_error"),
        (F.bool_or(F.col("width").isNotNull()) & F.bool_or(F.col("w").isNotNull())).alias("available"),
        F.bool_and("seen").alias("complete"),
    )


def occurrences(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def resource_retention(source: DataFrame, target: DataFrame, *by: str) -> DataFrame:
    """Per document, and by further columns of the source such as media_type, the share of resources (sha256, size) and of their bytes that the target has, counted with repeats."""
    groups = ["doc_id", *by]
    a = source.groupBy(*groups, "sha256", "size").agg(F.count("*").alias("n"))
    b = target.groupBy("doc_id", "sha256").agg(F.count("*").alias("m"))
    both = a.join(b, ["doc_id", "sha256"], "left").withColumn("kept", F.least("n", F.coalesce("m", F.lit(0))))
    share = lambda x, y: F.round(F.try_divide(x, y), 6)
    counts = share(F.sum("kept"), F.sum("n")).alias("count_ratio"), share(F.sum(F.col("kept") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("byte_ratio")
    return both.groupBy(*groups).agg(F.sum("n").alias("resources"), F.sum("kept").alias("kept"), *counts)


def font_retention(source: DataFrame, target: DataFrame) -> DataFrame:
    both = source.join(target.withColumnRenamed("runs", "m"), ["doc_id", "font"], "left")
    return both.groupBy("doc_id").agg(F.sum("runs").alias("runs"), F.sum(F.least("runs", F.coalesce("m", F.lit(0)))).alias("kept"), F.round(F.sum(F.least("runs", F.coalesce("m", F.lit(0)))) / F.sum("runs"), 6).alias("ratio"))


#: How objects are paired, stage by stage over what is left.
PAIRED_BY = [("origin", ["format", "origin", "kind", "hash"]), ("origin", ["format", "origin"]), ("content", ["kind", "hash"]), ("place", ["kind", "place"])]


def diff_objects(source: DataFrame, target: DataFrame, in_task: int = 100_000) -> DataFrame:
    """One row per object (doc_id, place, kind, hash, format, origin, role, box) of either side: retained, changed (edited, moved, resized), lost or added.

    Pairs are made one to one in stages, each over what is left: equal origin in equal
    formats (equal contents first), equal content, equal place and kind; of several with
    one key by order of place.  Objects of one format with different origins are
    different objects: they are never paired by content or place.  An object without an
    origin may be any.  basis says by what a pair was made, and ambiguous that either
    side had several objects with the key.  role (heading1 and so on, null for other
    text) and box (an array of numbers) may lack; change names the first of content,
    place and box that differs, source_role and target_role are given as they are.  The
    objects of a document are brought together once, about in_task objects to a task.
    """
    def carried(df: DataFrame) -> Column:
        absent = {"role": F.lit(None).cast("string"), "box": F.lit(None).cast("array<double>")}
        return F.struct("place", "kind", "hash", "format", "origin", *(F.col(c) if c in df.columns else null.alias(c) for c, null in absent.items()))

    absent, sure = F.lit(None).cast("string"), F.lit(False)
    sides = source.select("doc_id", carried(source).alias("o"), F.lit(True).alias("is_x")).union(target.select("doc_id", carried(target), F.lit(False)))
    tasks = max(-(-sides.count() // in_task), int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = sides.repartition(tasks, "doc_id").withColumns({"partner": F.when(F.lit(False), F.col("o")), "basis": absent, "ambiguous": sure})  # the one exchange of all stages
    for basis, keys in PAIRED_BY:
        named = [F.col(f"o.{k}").alias(f"k{i}") for i, k in enumerate(keys)]
        whole = F.col("doc_id").isNotNull()
        for k in keys:
            whole &= F.col(f"o.{k}").isNotNull()
        open_rows = rows.select("*", *named, F.col("basis").isNull().alias("open"), F.when(~whole, F.col("is_x")).alias("lone"))
        group = ["doc_id", "open", "lone", *(f"k{i}" for i in range(len(keys)))]
        same = W.partitionBy(*group, "is_x")
        open_rows = open_rows.withColumns({"nth": F.row_number().over(same.orderBy("o.place")), "several": F.count("*").over(same) > 1})
        pair = W.partitionBy(*group, "nth")
        side = lambda of: F.first(F.when(of, F.col("o")), True).over(pair)  # noqa: E731, B023
        open_rows = open_rows.withColumns({"x": side(F.col("is_x")), "y": side(~F.col("is_x")), "several": F.bool_or("several").over(pair)})
        others = F.col("x.origin").isNotNull() & F.col("y.origin").isNotNull() & F.col("x.format").eqNullSafe(F.col("y.format")) & (F.col("x.origin") != F.col("y.origin"))
        open_rows = open_rows.withColumn("fits", F.col("open") & F.col("lone").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & ~others)
        new = lambda value, old: F.when(F.col("fits"), value).otherwise(F.col(old)).alias(old)
        rows = open_rows.where("is_x or not fits").select("doc_id", "o", "is_x", new(F.col("y"), "partner"), new(F.lit(basis), "basis"), new(F.col("several"), "ambiguous"))
    x = F.when(F.col("is_x"), F.col("o"))
    out = rows.select("doc_id", "basis", "ambiguous", "is_x", F.col("o.kind").alias("kind"), x.alias("x"), F.when(F.col("is_x"), F.col("partner")).otherwise(F.col("o")).alias("y"))
    change = F.when(F.col("x.hash") != F.col("y.hash"), "edited").when(F.col("x.place") != F.col("y.place"), "moved").when(F.col("x.box") != F.col("y.box"), "resized").otherwise("retained")
    change = F.when(F.col("basis").isNotNull(), change).when(F.col("is_x"), "lost").otherwise("added")
    return out.select("doc_id", "kind", F.col("x.place").alias("source_place"), F.col("y.place").alias("target_place"), change.alias("change"), "basis", "ambiguous", F.col("x.role").alias("source_role"), F.col("y.role").alias("target_role"))


def exact_text_gate(source: DataFrame, target: DataFrame) -> DataFrame:
    """unmatched: source paragraphs (not blank) that the target lacks, with repeats; accepted if none, so also where all source paragraphs are blank."""
    hashed = F.when(F.trim("text") != "", F.unhex(F.sha2("text", 256))).alias("h")
    rows = source.select("doc_id", hashed, F.lit(1).alias("n")).union(target.select("doc_id", hashed, F.lit(-1))).where("h is not null or n > 0")
    texts = rows.repartition("doc_id").groupBy("doc_id", "h").agg(F.sum("n").alias("more"), F.max("n").alias("side"))  # the one exchange
    lacking = F.when(F.col("h").isNotNull(), F.greatest("more", F.lit(0))).otherwise(0)
    out = texts.groupBy("doc_id").agg(F.sum(lacking).alias("unmatched"), F.max("side").alias("side")).where("side > 0")
    return out.select("doc_id", "unmatched", (F.col("unmatched") == 0).alias("accepted"))


def text_flow_gate(source: DataFrame, target: DataFrame) -> DataFrame:
    """Equal sequences of words over all blocks in order; white space and block borders do not count."""

    def flow(df):
        parts = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
        whole = F.array_join(F.transform("b", lambda e: e["text"]), "\n")
        return parts.select("doc_id", F.sha2(F.trim(F.regexp_replace(whole, r"(?U)\s+", " ")), 256).alias("h"))

    return flow(source).join(flow(target).withColumnRenamed("h", "g"), "doc_id", "left").select("doc_id", F.coalesce(F.col("h") == F.col("g"), F.lit(False)).alias("accepted"))


def _object_gate(diff: DataFrame, bad: Column, name: str, limit: int, inventories: DataFrame) -> DataFrame:
    """doc_id, the number of bad rows (null unless it is certain), accepted, reason."""
    unsure = F.col("ambiguous") | F.coalesce(F.col("basis") == "place", F.lit(False))
    out = diff.groupBy("doc_id").agg(F.count_if(bad).alias("n"), (F.count_if(unsure) > 0).alias("unsure")).join(inventories.select("doc_id", "complete"), "doc_id", "full")
    known, n = F.coalesce("complete", F.lit(False)), F.coalesce("n", F.lit(0))
    reason = F.when(~known, "unavailable").when(F.col("unsure"), "uncertain-matching").when(n > limit, "budget-exceeded").otherwise("accepted")
    return out.select("doc_id", F.when(reason.isin("accepted", "budget-exceeded"), n).alias(name), (reason == "accepted").alias("accepted"), reason.alias("reason"))


def object_budget(diff: DataFrame, limit: int, inventories: DataFrame) -> DataFrame:
    """Objects lost per document against a limit.

    inventories (doc_id, complete) says of which documents both sides were listed whole.
    A document is refused if pairs were ambiguous or made by place alone
    (uncertain-matching), or if the inventories do not have it as complete (unavailable);
    a complete one without objects loses nothing.
    """
    return _object_gate(diff, F.col("change") == "lost", "lost", limit, inventories)


def heading_budget(diff: DataFrame, limit: int, inventories: DataFrame) -> DataFrame:
    """Headings that are lost, or whose role is another one (also a paragraph that became a heading), against a limit; refused like lost objects.

    A heading that moved or whose text was edited is no changed heading.
    """
    lost = (F.col("change") == "lost") & F.col("source_role").isNotNull()
    other = ~F.col("change").isin("lost", "added") & ~F.col("source_role").eqNullSafe(F.col("target_role"))
    return _object_gate(diff, lost | other, "changed", limit, inventories)


def formula_budget(source: DataFrame, target: DataFrame, limit: int) -> DataFrame:
    """Formulas (doc_id, fingerprint) whose number differs between the sides."""
    both = occurrences(source, "doc_id", "fingerprint").join(occurrences(target, "doc_id", "fingerprint").withColumnRenamed("n", "m"), ["doc_id", "fingerprint"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    out = both.groupBy("doc_id").agg(F.greatest(F.sum(F.greatest(n - m, F.lit(0))), F.sum(F.greatest(m - n, F.lit(0)))).alias("changed"))
    return out.select("doc_id", "changed", (F.col("changed") <= limit).alias("accepted"))


def emphasis_budget(source: DataFrame, target: DataFrame, limit: int) -> DataFrame:
    """Characters (not white space) whose bold or italic state differs; null and refused if the texts differ.

    Runs (doc_id, pos, text, bold, italic) become intervals of character offsets; the
    intervals of both sides are cut at each other's borders, so a long run is a few rows.
    """

    def intervals(df):
        bare = df.withColumn("text", F.regexp_replace("text", r"(?U)\s+", "")).withColumn("n", F.length("text"))
        order = W.partitionBy("doc_id").orderBy("pos")
        state = (F.col("bold").cast("int") * 2 + F.col("italic").cast("int")).alias("state")
        return bare.select("doc_id", "pos", "text", state, F.sum("n").over(order).alias("stop"), F.col("n"))

    def whole(df, name):
        return df.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), ""), 256).alias(name))

    a, b = intervals(source), intervals(target)
    same = whole(a, "h").join(whole(b, "g"), "doc_id", "left").select("doc_id", F.coalesce(F.col("h") == F.col("g"), F.lit(False)).alias("same"))
    marks = a.where("n > 0").select("doc_id", "stop", F.col("state").alias("x"), F.lit(None).cast("int").alias("y")).union(b.where("n > 0").select("doc_id", "stop", F.lit(None).cast("int"), "state"))
    cut = marks.groupBy("doc_id", "stop").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    back = W.partitionBy("doc_id").orderBy("stop").rowsBetween(0, W.unboundedFollowing)
    cut = cut.select("doc_id", (F.col("stop") - F.coalesce(F.lag("stop").over(W.partitionBy("doc_id").orderBy("stop")), F.lit(0))).alias("n"), F.first("x", True).over(back).alias("x"), F.first("y", True).over(back).alias("y"))
    changed = cut.groupBy("doc_id").agg(F.sum(F.when(F.col("x") != F.col("y"), F.col("n")).otherwise(0)).alias("changed"))
    out = same.join(changed, "doc_id", "left").select("doc_id", F.when(F.col("same"), F.coalesce("changed", F.lit(0))).alias("changed"))
    return out.select("doc_id", "changed", F.coalesce(F.col("changed") <= limit, F.lit(False)).alias("accepted"))


def loss_budget(issues: DataFrame, limit: int) -> DataFrame:
    out = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "loss").alias("losses"))
    return out.select("doc_id", "losses", (F.col("losses") <= limit).alias("accepted"))


def word_edit_distance(pairs: DataFrame, limit: int) -> DataFrame:
    """doc_id, distance (null if over the limit or too much work), at_least, accepted; equal texts are not compared word by word."""
    equal = F.md5("left_text") == F.md5("right_text")
    found = helpers.edit_distances(limit)("left_text", "right_text")
    rows = pairs.where(~equal).select("doc_id", found.alias("e")).select("doc_id", "e.distance", "e.at_least")
    same = pairs.where(equal).select("doc_id", F.lit(0).alias("distance"), F.lit(0).alias("at_least"))
    return rows.union(same).withColumn("accepted", F.col("distance").isNotNull())


def quality_gates(**gates: DataFrame) -> DataFrame:
    """accepted: every given gate accepts; failed: the names of those that do not. A document that a gate does not know is refused by it."""
    long, docs = None, None
    for name, g in gates.items():
        rows = g.select("doc_id", F.lit(name).alias("gate"), "accepted")
        long = rows if long is None else long.union(rows)
        docs = rows.select("doc_id") if docs is None else docs.union(rows.select("doc_id"))
    passed = long.groupBy("doc_id").agg(F.collect_set(F.when(F.col("accepted"), F.col("gate"))).alias("ok"))
    failed = F.array_join(F.array_sort(F.array_except(F.array(*(F.lit(n) for n in sorted(gates))), "ok")), ",")
    return passed.select("doc_id", (failed == "").alias("accepted"), failed.alias("failed"))


def latest_measurement(measures: DataFrame, revisions: DataFrame) -> DataFrame:
    """The newest measurement of each task and page, if it belongs to the task's present revision."""
    newest = measures.groupBy("task_id", "page").agg(F.max_by(F.struct("revision", "value"), "ts").alias("m"))
    return newest.select("task_id", "page", F.col("m.revision").alias("revision"), F.col("m.value").alias("value")).join(revisions, ["task_id", "revision"], "left_semi")


def compare_rasters(pairs: DataFrame) -> DataFrame:
    """Grey rasters (pair_id, ref, cand, width): similarity, rmse (both as shares of 255), distance of 64-bit difference hashes, overlap of what is darker than 246; accepted by similarity, distance and overlap."""

    @F.pandas_udf("similarity double, rmse double, hash_distance int, overlap double")
    def measure(ref: pd.Series, cand: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, w in zip(ref, cand, width, strict=True):
            a, b = (np.asarray(v, float).reshape(-1, int(w)) for v in (a, b))
            ink_a, ink_b = a < 246, b < 246
            union = (ink_a | ink_b).sum()
            bits = helpers.difference_bits(a) ^ helpers.difference_bits(b)
            out.append((max(0.0, 1 - np.abs(a - b).mean() / 255), float(np.sqrt(((a - b) ** 2).mean())) / 255, bits.bit_count(), float((ink_a & ink_b).sum() / union) if union else 1.0))
        return pd.DataFrame(out, columns=["similarity", "rmse", "hash_distance", "overlap"])

    got = pairs.select("pair_id", measure("ref", "cand", "width").alias("m")).select("pair_id", "m.*")
    return got.withColumn("accepted", (F.col("similarity") >= LEAST_SIMILARITY) & (F.col("hash_distance") <= MOST_HASH_DISTANCE) & (F.col("overlap") >= LEAST_OVERLAP))


TARGET = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), ' ') WHEN 2 THEN text || chr(10) || 'added line' ELSE replace(text, ' the ', ' a ') END AS text FROM {documents}"
OBJECTS = "SELECT doc_id, place, CASE WHEN place % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, 'h' || CAST((doc_id * 7 + place * place) % (CASE WHEN doc_id % 4 = 1 THEN 5 ELSE 11 END) AS STRING) AS hash, 'docx' AS format, CASE WHEN place % 3 = 0 THEN CAST(place AS STRING) END AS origin, CASE WHEN place % 4 = 0 THEN 'heading1' END AS role FROM (SELECT doc_id, CAST(e AS BIGINT) AS place FROM {documents}, (SELECT l_linenumber AS e FROM {lineitem} GROUP BY l_linenumber) n)"
OBJECTS_T = "SELECT doc_id, place + doc_id % 2 AS place, kind, CASE WHEN (doc_id + place) % 6 = 0 THEN 'edited' ELSE hash END AS hash, CASE WHEN doc_id % 5 < 2 THEN 'html' ELSE format END AS format, CASE WHEN (doc_id + place) % 7 = 0 THEN origin || 'x' ELSE origin END AS origin, CASE WHEN doc_id % 9 = 2 THEN 'heading2' ELSE role END AS role FROM (" + OBJECTS + ") o WHERE (doc_id * 3 + place) % 8 <> 0"
GEOMETRY = "SELECT doc_id, CAST(doc_id % 7 AS INT) AS page, 595.0E0 + doc_id % 3 AS width, 842.0E0 - doc_id % 5 AS height, 50.0E0 AS m1, 40.0E0 AS m2, 50.0E0 + doc_id % 2 AS m3, 40.0E0 AS m4 FROM {documents} UNION ALL SELECT doc_id, 9, 595.0E0, 842.0E0, 50.0E0, 40.0E0, 50.0E0, 40.0E0 FROM {documents} WHERE doc_id % 6 = 0"
GEOMETRY_T = "SELECT doc_id, CAST(doc_id % 7 AS INT) AS page, 595.0E0 + doc_id % 4 AS width, 842.0E0 AS height, 50.0E0 + doc_id % 4 AS m1, 40.0E0 AS m2, 50.0E0 AS m3, 41.0E0 AS m4 FROM {documents} WHERE doc_id % 10 <> 3"
RESOURCES = "SELECT CAST(l_orderkey % 1000 AS BIGINT) AS doc_id, 'r' || CAST(l_partkey % 13 AS STRING) AS sha256, CAST(100 + (l_partkey % 13) * 10 AS BIGINT) AS size, CASE WHEN l_partkey % 13 < 4 THEN 'image/png' ELSE 'image/svg+xml' END AS media_type, 'f' || CAST(l_suppkey % 4 AS STRING) AS font FROM {lineitem}"
FORMULAS = "SELECT CAST(l_orderkey % 2000 AS BIGINT) AS doc_id, 'f' || CAST(l_quantity % 9 AS STRING) AS fingerprint FROM {lineitem}"
RUNS = "SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS BIGINT) AS pos, text, turn % 2 = 0 AS bold, turn % 3 = 0 AS italic FROM {conversations}"
RUNS_T = "SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn * 2 AS BIGINT) AS pos, substr(text, 1, 10) AS text, turn % 2 = 0 AS bold, turn % 3 = 0 AS italic FROM {conversations} UNION ALL SELECT CAST(conv_id AS BIGINT), CAST(turn * 2 + 1 AS BIGINT), substr(text, 11) || CASE WHEN conv_id % 7 = 0 THEN 'x' ELSE ' ' END, turn % 2 = 0 OR conv_id % 3 = 0, turn % 3 = 0 FROM {conversations}"
INVENTORIES = "SELECT doc_id, doc_id % 11 <> 5 AS complete FROM {documents}"
ISSUES = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'loss' ELSE 'info' END AS severity FROM {lineitem}"
PAIRS = "SELECT doc_id, text AS left_text, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'start ' || text || ' end' WHEN 2 THEN replace(text, ' the ', ' a ') ELSE substr(text, 1, 200) END AS right_text FROM {documents}"
MEASURES = "SELECT user_id AS task_id, CAST(event_id % 5 AS INT) AS page, event_id AS ts, 'r' || CAST(event_id % 3 AS STRING) AS revision, value FROM {events}"
REVISIONS = "SELECT DISTINCT user_id AS task_id, 'r' || CAST(user_id % 3 AS STRING) AS revision FROM {events}"


def _blocks(s, d, sql=None):
    from .corpus import to_blocks

    docs = derived(s, d, TARGET, "documents") if sql else table(s, d, "documents")
    kind = F.when(F.length("text") < 60, "heading").otherwise("paragraph")
    return to_blocks(docs).withColumn("kind", kind)


def _objects(s, d):
    return derived(s, d, OBJECTS, "documents", "lineitem"), derived(s, d, OBJECTS_T, "documents", "lineitem")


def _resources(s, d):
    rows = derived(s, d, RESOURCES, "lineitem")
    return rows, rows.where("not (sha256 = 'r3' or (doc_id % 4 = 0 and sha256 = 'r5'))")


def _fonts(s, d):
    a, b = _resources(s, d)
    return a.groupBy("doc_id", "font").agg(F.count("*").alias("runs")), b.groupBy("doc_id", "font").agg(F.count("*").alias("runs"))


def _rasters(s, d):
    vec = table(s, d, "embeddings")
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255).cast("int"))))
    rows = vec.select("vec_id", grey.alias("g"))
    pair = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("cand")), "vec_id")
    return pair.select(F.col("vec_id").alias("pair_id"), F.col("g").alias("ref"), "cand", F.lit(16).alias("width"))


_LINES = "SELECT doc_id, pos, text, CASE WHEN length(text) < 60 THEN 'heading' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({})))"
_SRC, _TGT = _LINES.format("SELECT * FROM documents"), _LINES.format(plain(TARGET, "documents"))
_METRICS = "SELECT doc_id, unnest(['blocks', 'headings', 'paragraphs', 'list_items', 'characters', 'runs', 'links']) AS metric, unnest([count(*), count(*) FILTER (kind = 'heading'), count(*) FILTER (kind = 'paragraph'), 0, sum(length(text))::BIGINT, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT, count(*) FILTER (regexp_matches(text, 'https?://'))]) AS value FROM ({}) GROUP BY doc_id"
_RES = plain(RESOURCES, "lineitem")
_REST = f"SELECT * FROM ({_RES}) WHERE NOT (sha256 = 'r3' OR (doc_id % 4 = 0 AND sha256 = 'r5'))"
_EXACT = f"SELECT doc_id, coalesce(u, 0)::BIGINT AS unmatched, coalesce(u, 0) = 0 AS accepted FROM (SELECT DISTINCT doc_id FROM ({_SRC})) LEFT JOIN (SELECT doc_id, sum(greatest(n - coalesce(m, 0), 0)) AS u FROM (SELECT doc_id, text, count(*) AS n FROM ({_SRC}) WHERE trim(text) <> '' GROUP BY ALL) LEFT JOIN (SELECT doc_id, text, count(*) AS m FROM ({_TGT}) GROUP BY ALL) USING (doc_id, text) GROUP BY doc_id) USING (doc_id)"
_FLOW = f"SELECT doc_id, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) = trim(regexp_replace(t.text, '\\s+', ' ', 'g')) AS accepted FROM documents d JOIN ({plain(TARGET, 'documents')}) t USING (doc_id)"
_O, _OT = plain(OBJECTS, "documents", "lineitem"), plain(OBJECTS_T, "documents", "lineitem")


def _stage(n: int, basis: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = y.{c}" for c in ["doc_id", *keys, "k"])
    return f"""
    x{n} AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, {k}) AS c FROM a{n} WINDOW w AS (PARTITION BY doc_id, {k} ORDER BY place)), y{n} AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, {k}) AS c FROM b{n} WINDOW w AS (PARTITION BY doc_id, {k} ORDER BY place)),
    p{n} AS MATERIALIZED (SELECT x.doc_id, x.kind, x.place AS sp, y.place AS tp, x.hash AS h, y.hash AS g, '{basis}' AS basis, greatest(x.c, y.c) > 1 AS ambiguous, x.role AS source_role, y.role AS target_role FROM x{n} x JOIN y{n} y ON {on} AND (x.origin IS NULL OR y.origin IS NULL OR x.format <> y.format OR x.origin = y.origin)),
    a{n + 1} AS MATERIALIZED (SELECT * FROM a{n} WHERE (doc_id, place) NOT IN (SELECT (doc_id, sp) FROM p{n})), b{n + 1} AS MATERIALIZED (SELECT * FROM b{n} WHERE (doc_id, place) NOT IN (SELECT (doc_id, tp) FROM p{n}))"""


_DIFF = f"""
WITH a0 AS MATERIALIZED ({_O}), b0 AS MATERIALIZED ({_OT}), {_stage(0, 'origin', ['format', 'origin', 'kind', 'hash'])}, {_stage(1, 'origin', ['format', 'origin'])}, {_stage(2, 'content', ['kind', 'hash'])}, {_stage(3, 'place', ['kind', 'place'])},
diff AS (SELECT doc_id, kind, sp AS source_place, tp AS target_place, CASE WHEN h <> g THEN 'edited' WHEN sp <> tp THEN 'moved' ELSE 'retained' END AS change, basis, ambiguous, source_role, target_role FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
  UNION ALL SELECT doc_id, kind, place, NULL, 'lost', NULL, false, role, NULL FROM a4 UNION ALL SELECT doc_id, kind, NULL, place, 'added', NULL, false, NULL, role FROM b4)
"""


def _gate_sql(bad: str, name: str, limit: int) -> str:
    known = f"({plain(INVENTORIES, 'documents')})"
    return f"""SELECT doc_id, CASE WHEN reason IN ('accepted', 'budget-exceeded') THEN n END AS {name}, reason = 'accepted' AS accepted, reason FROM (
    SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN NOT coalesce(complete, false) THEN 'unavailable' WHEN u > 0 THEN 'uncertain-matching' WHEN n > {limit} THEN 'budget-exceeded' ELSE 'accepted' END AS reason FROM
    (SELECT doc_id, count(*) FILTER ({bad}) AS n, count(*) FILTER (ambiguous OR basis = 'place') AS u FROM diff GROUP BY doc_id) FULL JOIN {known} USING (doc_id))"""


_FORM = plain(FORMULAS, "lineitem")

QUERIES = {
    "inspect_blocks": lambda s, d: inspect_blocks(_blocks(s, d)),
    "compare_metrics": lambda s, d: compare_metrics(inspect_blocks(_blocks(s, d)), inspect_blocks(_blocks(s, d, TARGET))).withColumn("ratio", F.round("ratio", 6)),
    "page_geometry": lambda s, d: page_geometry(*(derived(s, d, sql, "documents").withColumn("margins", F.array("m1", "m2", "m3", "m4")) for sql in (GEOMETRY, GEOMETRY_T))),
    "resource_retention": lambda s, d: resource_retention(*_resources(s, d)),
    "media_retention": lambda s, d: resource_retention(*_resources(s, d), "media_type"),
    "font_retention": lambda s, d: font_retention(*_fonts(s, d)),
    "diff_objects": lambda s, d: diff_objects(*_objects(s, d)),
    "exact_text_gate": lambda s, d: exact_text_gate(_blocks(s, d), _blocks(s, d, TARGET)),
    "text_flow_gate": lambda s, d: text_flow_gate(_blocks(s, d), _blocks(s, d, TARGET)),
    "object_budget": lambda s, d: object_budget(diff_objects(*_objects(s, d)), 0, derived(s, d, INVENTORIES, "documents")),
    "formula_budget": lambda s, d: formula_budget(derived(s, d, FORMULAS, "lineitem"), derived(s, d, FORMULAS, "lineitem").where("not (fingerprint = 'f3.0' and doc_id % 2 = 0)"), 3),
    "emphasis_budget": lambda s, d: emphasis_budget(derived(s, d, RUNS, "conversations"), derived(s, d, RUNS_T, "conversations"), 500),
    "heading_budget": lambda s, d: heading_budget(diff_objects(*_objects(s, d)), 0, derived(s, d, INVENTORIES, "documents")),
    "loss_budget": lambda s, d: loss_budget(derived(s, d, ISSUES, "lineitem"), 1),
    "word_edit_distance": lambda s, d: word_edit_distance(derived(s, d, PAIRS, "documents"), 8),
    "quality_gates": lambda s, d: quality_gates(exact_text=exact_text_gate(_blocks(s, d), _blocks(s, d, TARGET)), text_flow=text_flow_gate(_blocks(s, d), _blocks(s, d, TARGET)), objects=object_budget(diff_objects(*_objects(s, d)), 2, derived(s, d, INVENTORIES, "documents"))),
    "latest_measurement": lambda s, d: latest_measurement(derived(s, d, MEASURES, "events"), derived(s, d, REVISIONS, "events")),
    "compare_rasters": lambda s, d: compare_rasters(_rasters(s, d)),
}

SQL = {
    "inspect_blocks": _METRICS.format(_SRC),
    "compare_metrics": f"SELECT doc_id, metric, coalesce(a.value, 0) AS source, coalesce(b.value, 0) AS target, round(CASE WHEN coalesce(a.value, 0) = 0 THEN 1.0 ELSE coalesce(b.value, 0)::DOUBLE / a.value END, 6) AS ratio, coalesce(b.value, 0) < coalesce(a.value, 0) AS lost FROM ({_METRICS.format(_SRC)}) a FULL JOIN ({_METRICS.format(_TGT)}) b USING (doc_id, metric)",
    "page_geometry": f"SELECT doc_id, max(e) AS max_error, round(sqrt(avg(e * e)), 6) AS rms_error, max(list_max(g)) AS max_margin_error, round(sqrt(sum(list_sum(list_transform(g, lambda x: x * x))) / sum(len(g))), 6) AS rms_margin_error, count(wa) > 0 AND count(wb) > 0 AS available, bool_and(wa IS NOT NULL AND wb IS NOT NULL) AS complete FROM (SELECT doc_id, a.width AS wa, b.width AS wb, CASE WHEN a.width IS NOT NULL AND b.width IS NOT NULL THEN greatest(abs(a.width - b.width), abs(a.height - b.height)) END AS e, CASE WHEN a.width IS NOT NULL AND b.width IS NOT NULL THEN [abs(a.m1 - b.m1), abs(a.m2 - b.m2), abs(a.m3 - b.m3), abs(a.m4 - b.m4)] END AS g FROM ({plain(GEOMETRY, 'documents')}) a FULL JOIN ({plain(GEOMETRY_T, 'documents')}) b USING (doc_id, page)) GROUP BY doc_id",
    "resource_retention": f"SELECT doc_id, sum(n)::BIGINT AS resources, sum(k)::BIGINT AS kept, round(sum(k) / sum(n)::DOUBLE, 6) AS count_ratio, round(sum(k * size) / sum(n * size)::DOUBLE, 6) AS byte_ratio FROM (SELECT *, least(n, coalesce(m, 0)) AS k FROM (SELECT doc_id, sha256, size, count(*) AS n FROM ({_RES}) GROUP BY ALL) LEFT JOIN (SELECT doc_id, sha256, count(*) AS m FROM ({_REST}) GROUP BY ALL) USING (doc_id, sha256)) GROUP BY doc_id",
    "media_retention": f"SELECT doc_id, media_type, sum(n)::BIGINT AS resources, sum(k)::BIGINT AS kept, round(sum(k) / sum(n)::DOUBLE, 6) AS count_ratio, round(sum(k * size) / sum(n * size)::DOUBLE, 6) AS byte_ratio FROM (SELECT *, least(n, coalesce(m, 0)) AS k FROM (SELECT doc_id, media_type, sha256, size, count(*) AS n FROM ({_RES}) GROUP BY ALL) LEFT JOIN (SELECT doc_id, sha256, count(*) AS m FROM ({_REST}) GROUP BY ALL) USING (doc_id, sha256)) GROUP BY doc_id, media_type",
    "font_retention": f"SELECT doc_id, sum(n)::BIGINT AS runs, sum(least(n, coalesce(m, 0)))::BIGINT AS kept, round(sum(least(n, coalesce(m, 0))) / sum(n)::DOUBLE, 6) AS ratio FROM (SELECT doc_id, font, count(*) AS n FROM ({_RES}) GROUP BY ALL) LEFT JOIN (SELECT doc_id, font, count(*) AS m FROM ({_REST}) GROUP BY ALL) USING (doc_id, font) GROUP BY doc_id",
    "diff_objects": _DIFF + "SELECT * FROM diff",
    "exact_text_gate": _EXACT,
    "text_flow_gate": _FLOW,
    "object_budget": _DIFF + _gate_sql("change = 'lost'", "lost", 0),
    "formula_budget": f"SELECT doc_id, greatest(sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)), sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0)))::BIGINT AS changed, greatest(sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)), sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0))) <= 3 AS accepted FROM (SELECT doc_id, fingerprint, count(*) AS n FROM ({_FORM}) GROUP BY ALL) FULL JOIN (SELECT doc_id, fingerprint, count(*) AS m FROM ({_FORM}) WHERE NOT (fingerprint = 'f3.0' AND doc_id % 2 = 0) GROUP BY ALL) USING (doc_id, fingerprint) GROUP BY doc_id",
    "emphasis_budget": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n END AS changed, doc_id % 7 <> 0 AND n <= 500 AS accepted FROM (SELECT conv_id AS doc_id, sum(CASE WHEN conv_id % 3 = 0 AND turn % 2 <> 0 THEN length(regexp_replace(substr(text, 11), '\\s+', '', 'g')) ELSE 0 END)::BIGINT AS n FROM conversations GROUP BY conv_id)",
    "heading_budget": _DIFF + _gate_sql("(change = 'lost' AND source_role IS NOT NULL) OR (change NOT IN ('lost', 'added') AND source_role IS DISTINCT FROM target_role)", "changed", 0),
    "loss_budget": f"SELECT doc_id, count(*) FILTER (severity = 'loss') AS losses, count(*) FILTER (severity = 'loss') <= 1 AS accepted FROM ({plain(ISSUES, 'lineitem')}) GROUP BY doc_id",
    "quality_gates": _DIFF + f", g AS (SELECT doc_id, 'exact_text' AS gate, accepted FROM ({_EXACT}) UNION ALL SELECT doc_id, 'text_flow', accepted FROM ({_FLOW}) UNION ALL SELECT doc_id, 'objects', accepted FROM ({_gate_sql("change = 'lost'", "lost", 2)})), h AS (SELECT doc_id, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT ok), '') AS failed FROM (SELECT doc_id, gate, coalesce(accepted, false) AS ok FROM (SELECT DISTINCT doc_id FROM g) CROSS JOIN (SELECT unnest(['exact_text', 'objects', 'text_flow']) AS gate) LEFT JOIN g USING (doc_id, gate)) GROUP BY doc_id) SELECT doc_id, failed = '' AS accepted, failed FROM h",
    "latest_measurement": f"SELECT task_id, page, revision, value FROM (SELECT task_id, page, arg_max(revision, ts) AS revision, arg_max(value, ts) AS value FROM ({plain(MEASURES, 'events')}) GROUP BY ALL) JOIN ({plain(REVISIONS, 'events')}) USING (task_id, revision)",
}
