"""Task, batch and dataset history: expiry, listings, roll-ups, selections, revisions."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.inputs import derived, plain
from ..sources.staging import kept
from .links import linked_groups

#: Seconds a task lives, states that are active, states of a batch, bytes in an archive, rows in the task centre.
TTL = 3600
ACTIVE = ["queued", "running", "cancelling"]
#: States that a service which starts again takes up.
LEFT_OVER = ["queued", "running"]
STATES = ["queued", "running", "done", "error", "expired", "interrupted"]
ARCHIVE_BYTES = 512 * 1024 * 1024
CENTRE = 12
#: Characters of a dataset's name, why a change is refused.
NAME = 80
REASONS = ["bad-name", "other-revision", "name-taken"]


def live_tasks(tasks: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """Tasks that are not older than ttl seconds."""
    return tasks.where(F.lit(now) - F.col("ts") <= ttl)


def recent_tasks(tasks: DataFrame, limit: int) -> DataFrame:
    return tasks.orderBy(F.desc("ts"), "task_id").limit(limit)


def task_snapshot(tasks: DataFrame, limit: int = CENTRE) -> DataFrame:
    """Active tasks first, then the newest; inputs of pipelines are not shown."""
    shown = tasks.where(F.col("queue_kind") != "pipeline-input").withColumn("active", F.col("status").isin(ACTIVE))
    return shown.orderBy(F.desc("active"), F.desc("ts"), "task_id").limit(limit)


def active_total(counts: DataFrame) -> DataFrame:
    """One row: how many tasks are active, from counts by status."""
    return counts.agg(F.coalesce(F.sum(F.when(F.col("status").isin(ACTIVE), F.col("n"))), F.lit(0)).alias("active"))


def task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("queue_kind") != "pipeline-input").groupBy("status").agg(F.count("*").alias("n"))


def batch_history(jobs: DataFrame, files: DataFrame, tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest jobs with their files' states; a file whose task is gone is expired.

    The six states are always counted, total counts files in any state; a job without
    files has zeros.
    """
    shown = jobs if limit is None else jobs.orderBy(F.desc("ts"), "job_id").limit(limit)
    states = files.join(tasks.select("task_id", "status"), "task_id", "left").withColumn("status", F.coalesce("status", F.lit("expired")))
    counted = states.groupBy("job_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATES), F.count("*").alias("total"))
    return shown.select("job_id", "target_format", "ts").join(counted, "job_id", "left").na.fill(0, [*STATES, "total"])


def batch_rollup(jobs: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """File counts by format and state with subtotals; nulls are totals."""
    states = files.join(tasks.select("task_id", "status"), "task_id", "left").join(jobs.select("job_id", "target_format"), "job_id")
    return states.rollup("target_format", F.coalesce("status", F.lit("expired")).alias("status")).agg(F.count("*").alias("n"))


def batch_detail(jobs: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each file of a job with its task's state and its own mode, else the job's."""
    rows = files.join(jobs.select("job_id", F.col("mode").alias("job_mode")), "job_id").join(tasks.select("task_id", "status"), "task_id", "left")
    return rows.select("job_id", "pos", "task_id", F.coalesce("status", F.lit("expired")).alias("status"), F.coalesce("mode", "job_mode").alias("mode"))


def selection_check(requested: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per job: is the selection valid (not empty, distinct, known), how many are skipped and how many can be retried."""
    known = files.select("job_id", "task_id").distinct()
    asked = requested.groupBy("job_id").agg(F.count("*").alias("asked"), F.count_distinct("task_id").alias("distinct"))
    found = requested.distinct().join(known, ["job_id", "task_id"], "left_semi").join(tasks, "task_id", "left")
    retry = (F.col("queue_kind") == "convert") & ~F.col("status").isin(ACTIVE)
    held = found.groupBy("job_id").agg(F.count("*").alias("known"), F.count_if(retry).alias("retryable"))
    total = known.groupBy("job_id").agg(F.count("*").alias("files"))
    rows = asked.join(held, "job_id", "left").join(total, "job_id", "left").na.fill(0)
    return rows.select("job_id", ((F.col("asked") == F.col("distinct")) & (F.col("distinct") == F.col("known"))).alias("valid"), (F.col("files") - F.col("known")).alias("skipped"), "retryable")


def archive_manifest(files: DataFrame, tasks: DataFrame, cap: int = ARCHIVE_BYTES) -> DataFrame:
    """Files of a job in order, their state, and the name each has in the archive.

    A done task's artifact is packed under the file's number in the job; a done task
    without one is unavailable, other tasks keep their state.  If the artifacts exceed
    the cap, or there is none, the archive is refused as a whole.
    """
    rows = files.join(tasks.select("task_id", "status", "artifact", "bytes"), "task_id", "left").withColumn("status", F.coalesce("status", F.lit("expired")))
    done = F.col("status") == "done"
    packed = done & (F.coalesce("artifact", F.lit("")) != "")
    job = W.partitionBy("job_id")
    order = job.orderBy("pos", "task_id")
    rows = rows.withColumns({"packed": packed, "size": F.when(packed, F.col("bytes")).otherwise(0), "nth": F.row_number().over(order)})
    rows = rows.withColumns({"running": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)), "all_bytes": F.sum("size").over(job), "n_packed": F.count_if("packed").over(job)})
    refused = F.when(F.col("all_bytes") > cap, "too_large").when(F.col("n_packed") == 0, "nothing_ready")
    name = F.when(F.col("packed") & refused.isNull(), F.format_string("%02d/%s", "nth", "artifact"))
    return rows.select("job_id", "pos", "task_id", F.when(done & ~F.col("packed"), "unavailable").otherwise(F.col("status")).alias("state"), name.alias("file"), "running", refused.alias("refused"))


def recover_tasks(tasks: DataFrame, kinds: DataFrame) -> DataFrame:
    """Tasks that were queued or running when the service stopped: resumed if their kind is known, else interrupted; those being cancelled are left alone."""
    rows = tasks.where(F.col("status").isin(LEFT_OVER)).join(kinds.select("queue_kind", F.lit(True).alias("known")), "queue_kind", "left")
    return rows.groupBy(F.when(F.col("known"), "resumed").otherwise("interrupted").alias("outcome")).agg(F.count("*").alias("n"))


def apply_updates(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows after updates that name the stored revision; of several the first wins, others are conflicts."""
    fitting = updates.join(base.select("id", "revision"), ["id", "revision"], "left_semi")
    first = fitting.groupBy("id").agg(F.min_by("snapshot", "update_id").alias("new"))
    tried = updates.groupBy("id").agg(F.count("*").alias("tried"))
    rows = base.join(first, "id", "left").join(tried, "id", "left")
    won = F.col("new").isNotNull()
    return rows.select("id", F.when(won, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.coalesce("new", "snapshot").alias("snapshot"), (F.coalesce("tried", F.lit(0)) - won.cast("int")).cast("long").alias("conflicts"))


def fold_saves(rows: list[tuple]) -> tuple[dict, list[tuple]]:
    """The datasets {(template, id): [name, revision, snapshot]} and the refused changes (update_id, template, id, reason) after rows in order.

    A row is (update_id or None, template, id, name, revision, snapshot); None: it is
    stored already.  A change without a revision is a new dataset, of revision 1; any
    other must name the stored revision, which then rises.  A name, whatever its case, is
    one dataset's of a template: a rename frees the old one for later changes.
    """
    held: dict[tuple, list] = {}
    owner: dict[tuple, object] = {}
    refused = []
    for update, template, key, name, revision, snapshot in rows:
        name = name if update is None else (name or "").strip()
        wanted, mine = (template, name.casefold()), held.get((template, key))
        new = update is None or revision is None
        if update is not None and not 0 < len(name) <= NAME:
            reason = "bad-name"
        elif not new and (mine is None or mine[1] != revision):
            reason = "other-revision"
        elif (new and mine) or owner.get(wanted, key) != key:
            reason = "name-taken"
        else:
            if mine:
                del owner[template, mine[0].casefold()]
            held[template, key] = [name, revision if update is None else 1 if new else revision + 1, snapshot]
            owner[wanted] = key
            continue
        refused.append((update, template, key, reason))
    return held, refused


def fold_apart(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """What fold_saves gives of rows in order where no name is ever two datasets': the rows of stored datasets, the row numbers of refused ones and their reasons (by REASONS).

    The first rows of all datasets are taken at once, then the second ones, and so on.
    """
    code = lambda c: np.asarray(rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1), np.int64)
    change, given = np.asarray(pc.is_valid(rows["update_id"])), np.asarray(pc.is_valid(rows["revision"]))
    asked, size = np.asarray(pc.fill_null(rows["revision"], 0)), np.asarray(pc.utf8_length(rows["name"]))
    template, key = code("template"), code("id")
    order = np.lexsort((key, template))  # rows of one dataset stay in order
    first = np.flatnonzero(np.diff(template[order], prepend=-2) | np.diff(key[order], prepend=-2))
    count = np.diff(first, append=len(order))
    held, revision, known = np.full(len(first), -1), np.zeros(len(first), np.int64), np.zeros(len(first), bool)
    reason = np.full(len(order), -1)
    live = np.arange(len(first))
    for nth in range(int(count.max(initial=0))):
        live = live[count[live] > nth]
        at = order[first[live] + nth]
        new = ~change[at] | ~given[at]
        fits = known[live] & (revision[live] == asked[at])
        why = np.where(change[at] & ((size[at] < 1) | (size[at] > NAME)), 0, np.where(~new & ~fits, 1, np.where(new & (held[live] >= 0), 2, -1)))
        reason[at] = why
        at, to, new = at[why < 0], live[why < 0], new[why < 0]
        held[to], known[to] = at, change[at] | given[at]
        revision[to] = np.where(change[at], np.where(new, 1, asked[at] + 1), asked[at])
    some, refused = held >= 0, np.flatnonzero(reason >= 0)
    stored = rows.take(pa.array(held[some]))
    stored = stored.set_column(stored.schema.get_field_index("revision"), "revision", pa.array(revision[some], mask=~known[some]))
    return stored, refused, reason[refused]


def save_datasets(base: DataFrame, changes: DataFrame, in_bucket: int = 10_000) -> DataFrame:
    """Datasets after changes, one saved after the other, and the changes that were refused.

    base: template, id, name (unique in its template), revision, snapshot; changes: update_id (their order), and
    the same columns, revision null for a new dataset.  Result: update_id (null for a
    dataset), template, id, name, revision, snapshot, reason (bad-name, other-revision,
    name-taken; null for a dataset).  Datasets of which no name is ever another one's are
    independent, and so are groups of datasets that names tie together; both are dealt to
    buckets of about in_bucket rows, a group in one.  Changes of equal update_id go by
    their other columns.
    """
    columns = ["template", "id", "name", "revision", "snapshot"]
    whole = lambda df: df.withColumn("revision", F.col("revision").cast("long"))
    said = changes.withColumn("name", T.trim_white(F.coalesce("name", F.lit(""))))
    both = whole(base).select(F.lit(None).cast("long").alias("update_id"), *columns).union(whole(said).select(F.col("update_id").cast("long"), *columns))
    rows = kept(both.withColumn("node", F.xxhash64("template", "id")), "saves")  # equal hashes only bring datasets together
    named = rows.where(F.length("name").between(1, NAME) | F.col("update_id").isNull()).select("node", F.xxhash64("template", T.casefold(T.trim_white(F.col("name")))).alias("key"))
    tied = named.distinct().withColumn("hub", F.min("node").over(W.partitionBy("key"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    buckets = max(1, -(-rows.count() // in_bucket))
    dealt = rows.join(linked_groups(tied), "node", "left")
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    bucket = F.when(F.col("root").isNotNull(), -1 - deal("root")).otherwise(deal("node"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"update_id long, template {kinds['template']}, id {kinds['id']}, name string, revision long, snapshot string, reason string"

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(["update_id", *columns])
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in table.column_names], null_placement="at_start"))
        if key[0].as_py() < 0:
            held, refused = fold_saves(list(zip(*(c.to_pylist() for c in table.columns), strict=True)))
            out = [(None, t, i, *values, None) for (t, i), values in held.items()] + [(u, t, i, None, None, None, reason) for u, t, i, reason in refused]
            fields = [*table.schema, pa.field("reason", pa.string())]
            return pa.table([pa.array(c, f.type) for f, c in zip(fields, zip(*out, strict=True), strict=True)], names=[f.name for f in fields])
        stored, at, reason = fold_apart(table)
        stored = stored.set_column(0, "update_id", pa.nulls(len(stored), pa.int64())).append_column("reason", pa.nulls(len(stored), pa.string()))
        refused = table.take(pa.array(at))
        for i, c in enumerate(table.column_names[3:], 3):
            refused = refused.set_column(i, c, pa.nulls(len(at), table.schema.field(c).type))
        refused = refused.append_column("reason", pa.array(REASONS).take(pa.array(reason)))
        return pa.concat_tables([stored.cast(refused.schema), refused])

    return dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(fold, schema)


def name_clashes(datasets: DataFrame) -> DataFrame:
    """Template and case-folded name of datasets that share both."""
    return datasets.groupBy("template", F.lower("name").alias("name_key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def library_upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base after changes (change_id, id or null, title, year, deleted).

    Changes of an id count as one: the last value that is not null of each field, and
    deleted if any of them says so (null: it does not).  Known ids keep what no change
    names; changes of unknown ids do nothing; rows without id get new ids after the
    greatest, in order of change_id.
    """
    edits = changes.where("id is not null").groupBy("id").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change_id"))).alias(f"new_{c}") for c in ("title", "year")), F.bool_or(F.coalesce("deleted", F.lit(False))).alias("gone")
    )
    updated = base.join(edits, "id", "left").where("not coalesce(gone, false)").select("id", F.coalesce("new_title", "title").alias("title"), F.coalesce("new_year", "year").alias("year"))
    # new ids by counts of ranges of change_id, so no window runs over the whole table
    fresh = changes.where("id is null")
    cuts = fresh.agg(F.coalesce(F.percentile_approx("change_id", [i / 64 for i in range(1, 64)], 10000), F.array().cast("array<bigint>")).alias("cuts"))  # one row
    parted = fresh.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("change_id"))))
    before = parted.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))  # 64 rows
    last = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    placed = parted.withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy("change_id"))).join(F.broadcast(before), "part").crossJoin(F.broadcast(last))
    return updated.union(placed.select((F.col("last") + F.coalesce("base", F.lit(0)) + F.col("nth")).alias("id"), "title", "year"))


def storage_bytes(files: DataFrame) -> DataFrame:
    """Files and bytes by kind of file, and in total."""
    return files.rollup("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


TASKS = """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS task_id, CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'error' WHEN 3 THEN 'interrupted' WHEN 4 THEN 'cancelling' ELSE 'done' END AS status,
  CAST(1700000000 + ((l_orderkey * 10 + l_linenumber) * 37) % 20000 AS BIGINT) AS ts, CASE (l_orderkey * 3 + l_linenumber) % 5 WHEN 0 THEN 'pipeline-input' WHEN 1 THEN 'ocr' WHEN 2 THEN 'gone' ELSE 'convert' END AS queue_kind,
  CAST((l_orderkey * 7919 + l_linenumber * 104729) % 200000000 AS BIGINT) AS bytes,
  CASE WHEN (l_orderkey + l_linenumber) % 9 > 4 AND l_orderkey % 4 <> 0 THEN 'result_' || CAST(l_linenumber AS STRING) || '.docx' END AS artifact
FROM {lineitem} WHERE (l_orderkey * 10 + l_linenumber) % 7 <> 0
"""
FILES = "SELECT l_orderkey + CASE WHEN l_orderkey % 10 = 1 THEN 1 ELSE 0 END AS job_id, CAST(l_linenumber AS BIGINT) AS pos, l_orderkey * 10 + l_linenumber AS task_id, CASE WHEN l_linenumber % 3 = 0 THEN 'exact' END AS mode FROM {lineitem}"
JOBS = "SELECT o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'txt' END AS target_format, CASE WHEN o_orderkey % 2 = 0 THEN 'fast' ELSE 'visual' END AS mode, CAST(1700000000 + (o_orderkey * 31) % 50000 AS BIGINT) AS ts FROM {orders}"
ASKED = "SELECT l_orderkey AS job_id, l_orderkey * 10 + l_linenumber + CASE WHEN l_orderkey % 11 = 0 THEN 9 ELSE 0 END AS task_id FROM {lineitem} WHERE l_linenumber <= 3"
BASE = "SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS BIGINT) AS revision, 'v' || CAST(o_orderkey AS STRING) AS snapshot, 't' || CAST(o_custkey % 40 AS STRING) AS template, CASE WHEN o_orderkey % 2 = 0 THEN 'Set ' ELSE 'set ' END || CAST(o_orderkey % 500 AS STRING) AS name FROM {orders}"
SAVED = "SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS BIGINT) AS revision, 'v' || CAST(o_orderkey AS STRING) AS snapshot, 't' || CAST(o_custkey % 40 AS STRING) AS template, 'Set ' || CAST(o_orderkey AS STRING) AS name FROM {orders}"
SAVES = """SELECT l_orderkey * 100 + l_linenumber AS update_id, 't' || CAST(o_custkey % 40 AS STRING) AS template, CASE WHEN l_linenumber = 6 THEN -l_orderkey ELSE l_orderkey END AS id, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(o_orderkey % 3 + l_linenumber - 1 AS BIGINT) END AS revision,
  CASE WHEN l_linenumber % 2 = 0 THEN 'SET ' ELSE ' set ' END || CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_partkey ELSE l_orderkey END AS STRING) AS name, 'u' || CAST(l_linenumber AS STRING) AS snapshot FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"""
UPDATES = "SELECT l_orderkey AS id, CAST(l_linenumber % 4 AS BIGINT) AS revision, l_orderkey * 100 + l_linenumber AS update_id, 'u' || CAST(l_linenumber AS STRING) AS snapshot FROM {lineitem}"
CHANGES = "SELECT o_orderkey AS change_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 3 END AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'new title ' || CAST(o_orderkey AS STRING) END AS title, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(2000 + o_orderkey % 25 AS BIGINT) END AS year, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 13 = 1 END AS deleted FROM {orders} WHERE o_orderkey % 5 < 2"
LIB = "SELECT p_partkey AS id, p_name AS title, CAST(1950 + p_partkey % 70 AS BIGINT) AS year FROM {part}"
STORED = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' ELSE 'docx' END AS ext, CAST(length(text) AS BIGINT) AS size FROM {documents}"
NOW = 1700019000


def _t(s, d):
    return derived(s, d, TASKS, "lineitem")


def _f(s, d):
    return derived(s, d, FILES, "lineitem")


def _j(s, d):
    return derived(s, d, JOBS, "orders")


_PT, _PF, _PJ = plain(TASKS, "lineitem"), plain(FILES, "lineitem"), plain(JOBS, "orders")
_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("queued", "running", "done", "error", "expired", "interrupted"))

QUERIES = {
    "live_tasks": lambda s, d: live_tasks(_t(s, d), NOW),
    "recent_tasks": lambda s, d: recent_tasks(_t(s, d), 50),
    "task_snapshot": lambda s, d: task_snapshot(_t(s, d)),
    "task_counts": lambda s, d: task_counts(_t(s, d)),
    "active_total": lambda s, d: active_total(task_counts(_t(s, d))),
    "batch_history": lambda s, d: batch_history(_j(s, d), _f(s, d), _t(s, d)),
    "batch_history_newest": lambda s, d: batch_history(_j(s, d), _f(s, d), _t(s, d), 20),
    "batch_rollup": lambda s, d: batch_rollup(_j(s, d), _f(s, d), _t(s, d)),
    "batch_detail": lambda s, d: batch_detail(_j(s, d), _f(s, d), _t(s, d)),
    "selection_check": lambda s, d: selection_check(derived(s, d, ASKED, "lineitem"), _f(s, d), _t(s, d)),
    "archive_manifest": lambda s, d: archive_manifest(_f(s, d), _t(s, d)),
    "recover_tasks": lambda s, d: recover_tasks(_t(s, d), _t(s, d).where("queue_kind in ('convert', 'ocr')").select("queue_kind").distinct()),
    "apply_updates": lambda s, d: apply_updates(derived(s, d, BASE, "orders"), derived(s, d, UPDATES, "lineitem")),
    "save_datasets": lambda s, d: save_datasets(derived(s, d, SAVED, "orders"), derived(s, d, SAVES, "lineitem", "orders")),
    "name_clashes": lambda s, d: name_clashes(derived(s, d, BASE, "orders")),
    "library_upsert": lambda s, d: library_upsert(derived(s, d, LIB, "part"), derived(s, d, CHANGES, "orders")),
    "storage_bytes": lambda s, d: storage_bytes(derived(s, d, STORED, "documents")),
}

SQL = {
    "live_tasks": f"SELECT * FROM ({_PT}) WHERE {NOW} - ts <= {TTL}",
    "recent_tasks": f"SELECT * FROM ({_PT}) ORDER BY ts DESC, task_id LIMIT 50",
    "task_snapshot": f"SELECT *, status IN ('queued', 'running', 'cancelling') AS active FROM ({_PT}) WHERE queue_kind <> 'pipeline-input' ORDER BY active DESC, ts DESC, task_id LIMIT {CENTRE}",
    "task_counts": f"SELECT status, count(*) AS n FROM ({_PT}) WHERE queue_kind <> 'pipeline-input' GROUP BY status",
    "active_total": f"SELECT count(*) AS active FROM ({_PT}) WHERE queue_kind <> 'pipeline-input' AND status IN ('queued', 'running', 'cancelling')",
    "batch_history": f"SELECT job_id, target_format, ts, {_COUNTS}, count(task_id) AS total FROM (SELECT j.job_id, target_format, j.ts, f.task_id, CASE WHEN f.task_id IS NULL THEN NULL ELSE coalesce(t.status, 'expired') END AS state FROM ({_PJ}) j LEFT JOIN ({_PF}) f USING (job_id) LEFT JOIN ({_PT}) t ON t.task_id = f.task_id) GROUP BY ALL",
    "batch_history_newest": f"SELECT job_id, target_format, ts, {_COUNTS}, count(task_id) AS total FROM (SELECT j.job_id, target_format, j.ts, f.task_id, CASE WHEN f.task_id IS NULL THEN NULL ELSE coalesce(t.status, 'expired') END AS state FROM (SELECT * FROM ({_PJ}) ORDER BY ts DESC, job_id LIMIT 20) j LEFT JOIN ({_PF}) f USING (job_id) LEFT JOIN ({_PT}) t ON t.task_id = f.task_id) GROUP BY ALL",
    "batch_rollup": f"SELECT target_format, st AS status, count(*) AS n FROM (SELECT target_format, coalesce(status, 'expired') AS st FROM ({_PJ}) JOIN ({_PF}) USING (job_id) LEFT JOIN ({_PT}) USING (task_id)) GROUP BY ROLLUP (target_format, st)",
    "batch_detail": f"SELECT f.job_id, pos, task_id, coalesce(status, 'expired') AS status, coalesce(f.mode, j.mode) AS mode FROM ({_PF}) f JOIN ({_PJ}) j USING (job_id) LEFT JOIN ({_PT}) USING (task_id)",
    "selection_check": f"""
        WITH a AS ({plain(ASKED, 'lineitem')}), k AS (SELECT DISTINCT job_id, task_id FROM ({_PF})),
        h AS (SELECT job_id, count(*) AS known, count(*) FILTER (queue_kind = 'convert' AND status NOT IN ('queued', 'running', 'cancelling')) AS retryable FROM (SELECT DISTINCT * FROM a) JOIN k USING (job_id, task_id) LEFT JOIN ({_PT}) USING (task_id) GROUP BY job_id)
        SELECT job_id, asked = d AND d = coalesce(known, 0) AS valid, coalesce(files, 0) - coalesce(known, 0) AS skipped, coalesce(retryable, 0) AS retryable
        FROM (SELECT job_id, count(*) AS asked, count(DISTINCT task_id) AS d FROM a GROUP BY job_id) LEFT JOIN h USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS files FROM k GROUP BY job_id) USING (job_id)""",
    "archive_manifest": f"""
        SELECT job_id, pos, task_id, CASE WHEN status = 'done' AND artifact IS NULL THEN 'unavailable' ELSE status END AS state, running, refused,
          CASE WHEN size IS NOT NULL AND refused IS NULL THEN lpad(nth::VARCHAR, greatest(2, length(nth::VARCHAR))::INT, '0') || '/' || artifact END AS file
        FROM (SELECT *, CASE WHEN sum(coalesce(size, 0)) OVER (PARTITION BY job_id) > 536870912 THEN 'too_large' WHEN count(size) OVER (PARTITION BY job_id) = 0 THEN 'nothing_ready' END AS refused,
            row_number() OVER o AS nth, (sum(coalesce(size, 0)) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT AS running
          FROM (SELECT job_id, pos, task_id, artifact, coalesce(status, 'expired') AS status, CASE WHEN status = 'done' AND artifact IS NOT NULL THEN bytes END AS size FROM ({_PF}) LEFT JOIN ({_PT}) USING (task_id))
          WINDOW o AS (PARTITION BY job_id ORDER BY pos, task_id))""",
    "recover_tasks": f"SELECT CASE WHEN queue_kind IN ('convert', 'ocr') THEN 'resumed' ELSE 'interrupted' END AS outcome, count(*) AS n FROM ({_PT}) WHERE status IN ('queued', 'running') GROUP BY 1",
    "apply_updates": f"SELECT b.id, revision + (new IS NOT NULL)::INT AS revision, coalesce(new, snapshot) AS snapshot, coalesce(tried, 0) - (new IS NOT NULL)::INT AS conflicts FROM ({plain(BASE, 'orders')}) b LEFT JOIN (SELECT u.id, arg_min(u.snapshot, update_id) AS new FROM ({plain(UPDATES, 'lineitem')}) u JOIN ({plain(BASE, 'orders')}) b ON b.id = u.id AND b.revision = u.revision GROUP BY u.id) f USING (id) LEFT JOIN (SELECT id, count(*) AS tried FROM ({plain(UPDATES, 'lineitem')}) GROUP BY id) t USING (id)",
    "name_clashes": f"SELECT template, lower(name) AS name_key, count(*) AS n, min(id) AS first_id FROM ({plain(BASE, 'orders')}) GROUP BY 1, 2 HAVING count(*) > 1",
    "library_upsert": f"""
        WITH c AS ({plain(CHANGES, 'orders')}), e AS (SELECT id, arg_max(title, change_id) FILTER (title IS NOT NULL) AS t, arg_max(year, change_id) FILTER (year IS NOT NULL) AS y, bool_or(coalesce(deleted, false)) AS gone FROM c WHERE id IS NOT NULL GROUP BY id)
        SELECT id, coalesce(t, title) AS title, coalesce(y, year) AS year FROM ({plain(LIB, 'part')}) LEFT JOIN e USING (id) WHERE NOT coalesce(gone, false)
        UNION ALL SELECT (SELECT max(id) FROM ({plain(LIB, 'part')})) + row_number() OVER (ORDER BY change_id), title, year FROM c WHERE id IS NULL""",
    "storage_bytes": f"SELECT ext, count(*) AS files, sum(size)::BIGINT AS bytes FROM ({plain(STORED, 'documents')}) GROUP BY ROLLUP (ext)",
}
