"""Cases of jobs: names, layout, libraries, histories, archives, gates, identifiers."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioworks.functions import helpers, text as T
from folioworks.operators import layout, matching, naming, quality, tasks, templates


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("title", "short"),
    [
        ("Исследование феррорезонансных процессов в сетях", "исследов_феррор._процесс._в_сетях"),
        ("Organization of the Measurement", "organiz_of_the_measurem"),
        ("The of", "the"),
        ("", ""),
        (None, ""),
        ("One-dimensional   models: of", "one-dimens._models."),
        ("a" * 80 + " tail", "aaaa._tail"),
        ("Двигательный стан", "двигател_стан"),
    ],
)
def test_abbreviated_titles(spark, title, short):
    assert one(spark, naming.abbreviate_title(F.col("t")), t=title) == short


def test_abbreviated_titles_fit(spark):
    assert one(spark, naming.abbreviate_title(F.col("t")), t="word " * 40) == "_".join(["word"] * 11)
    assert one(spark, naming.abbreviate_title(F.col("t"), 8), t="word of words") == "word"


def test_confidence_of_a_line_halves():
    # the line so far counts as much as the next word
    three = [("a", 0.0, 0.0, 5.0, 9.0, 1.0), ("b", 6.0, 0.0, 9.0, 9.0, 0.5), ("c", 10.0, 0.0, 14.0, 9.0, 0.0)]
    assert layout.fold_lines(three) == [("a b c", 0.0, 0.0, 14.0, 9.0, 0.375)]


def test_grids(spark):
    full = [(r, c, c * 10.0, r * 5.0, c * 10.0 + 9, r * 5.0 + 4) for r in range(2) for c in range(3)]
    tables = {1: full, 2: full[:-1], 3: full + full[:1], 4: full[:-1] + [(1, 2, 20.2, 5.0, 29.0, 9.0)], 5: full[:-1] + [(1, 2, 20.05, 5.0, 29.0, 9.0)], 6: full[:-1] + [(1, 2, 20.0, 5.0, 20.0, 9.0)]}
    df = spark.createDataFrame([(t, *c) for t, cells in tables.items() for c in cells], "table_id long, row int, col int, x0 double, y0 double, x1 double, y1 double")
    assert {r["table_id"]: r["regular"] for r in layout.table_grid(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    with pytest.raises(ValueError):
        layout.crop_table(df, (1, 0), (0, 1))
    assert layout.crop_table(df, (0, 5), (0, 1)).count() == 0


def test_polygon_box(spark):
    df = spark.createDataFrame([(1, 2, [3.0, 1.0, 4.0], [5.0, 9.0, 2.0])], "page_id long, word_id long, xs array<double>, ys array<double>")
    assert tuple(layout.polygon_box(df).first())[2:] == (1.0, 2.0, 4.0, 9.0)


def test_library_changes_of_one_id_count_as_one(spark):
    base = spark.createDataFrame([(1, "a", 1990), (2, "b", 1991), (3, "c", 1992)], "id long, title string, year long")
    rows = [(1, 1, "x", None, False), (2, 1, None, 2000, None), (3, 1, "y", None, None), (4, 2, "z", None, True), (5, None, "new", 2001, None), (6, 9, "unknown", None, None)]
    got = tasks.library_upsert(base, spark.createDataFrame(rows, "change_id long, id long, title string, year long, deleted boolean")).collect()
    assert sorted(map(tuple, got)) == [(1, "y", 2000), (3, "c", 1992), (4, "new", 2001)]


def test_history_keeps_empty_jobs_and_interrupted_files(spark):
    jobs = spark.createDataFrame([(1, "pdf", 5), (2, "txt", 6)], "job_id long, target_format string, ts long")
    files = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13)], "job_id long, task_id long")
    states = spark.createDataFrame([(10, "interrupted"), (11, "cancelling"), (12, "done")], "task_id long, status string")
    got = {r["job_id"]: r for r in tasks.batch_history(jobs, files, states).collect()}
    assert (got[1]["interrupted"], got[1]["done"], got[1]["expired"], got[1]["total"]) == (1, 1, 1, 4)
    assert got[2]["total"] == 0 and got[2]["queued"] == 0


def test_archive_is_refused_as_a_whole(spark):
    files = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12), (2, 2, 13), (3, 1, 14)], "job_id long, pos long, task_id long")
    states = spark.createDataFrame([(10, "done", "a.docx", 60), (11, "done", None, 0), (12, "done", "a.pdf", 60), (13, "done", "b.pdf", 60), (14, "running", None, 0)], "task_id long, status string, artifact string, bytes long")
    got = [(r["state"], r["file"], r["refused"]) for r in tasks.archive_manifest(files, states, 100).orderBy("job_id", "pos").collect()]
    assert got == [("done", "01/a.docx", None), ("unavailable", None, None), ("done", None, "too_large"), ("done", None, "too_large"), ("running", None, "nothing_ready")]


def test_blank_documents_pass_the_exact_gate(spark):
    side = lambda *t: spark.createDataFrame([(1, x) for x in t], "doc_id long, text string")
    assert tuple(quality.exact_text_gate(side(""), side("x").limit(0)).first()) == (1, 0, True)
    assert tuple(quality.exact_text_gate(side("Same", "Same"), side("Same")).first()) == (1, 1, False)


def test_plain_text_does_not_leave_the_jvm(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def probe(text: pd.Series) -> pd.Series:
        seen.add(int(text.notna().sum()))
        return text

    real, helpers.nfkc = helpers.nfkc, probe
    try:
        spark.createDataFrame([("plain",), ("text",), ("Ａ",)], "t string").select(T.normalize_text(F.col("t"))).collect()
    finally:
        helpers.nfkc = real
    assert seen.value == 1


def test_fuzzy_authors_equal_brute_force(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(4, 9))) for _ in range(12)]
    texts = [" ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(3, 11))) for _ in range(6)) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, f"f{i}.txt") for i, t in enumerate(texts)], "doc_id long, text string, filename string")
    bib = spark.createDataFrame([(1, names[:5]), (2, names[5:10]), (3, names[10:])], "item_pos long, authors array<string>")
    got = {(r["doc_id"], r["author"]): r["score"] for r in matching.author_signal(matching.features(docs), bib).collect()}
    want = {}
    for i, t in enumerate(texts):
        for n in names:
            if n in t:
                want[i, n] = 1.0
            elif any(len(w) >= 4 and SequenceMatcher(None, n, w).ratio() >= 0.6 for w in t.split()):
                want[i, n] = 0.8
    assert got == pytest.approx(want)


def test_short_identifiers_are_found(spark):
    docs = spark.createDataFrame([(1, "see 10.1/AB and 1-2-3, of 19551", "a"), (2, "x/y", "b")], "doc_id long, text string, filename string")
    bib = spark.createDataFrame([(1, "10.1/ab", "1-23", 1955), (2, "x/Y", "", 551), (3, "", "", None)], "item_pos long, doi string, isbn string, year int")
    feats = matching.features(docs)
    pairs = lambda f: sorted((r["doc_id"], r["item_pos"]) for r in f(feats, bib).collect())
    assert pairs(matching.doi_match) == [(1, 1), (2, 2)] and pairs(matching.isbn_match) == [(1, 1)] and pairs(matching.year_match) == [(1, 1), (1, 2)]


def listed(spark):
    return spark.createDataFrame([(1, True)], "doc_id long, complete boolean")


OBJECT = "doc_id long, place long, kind string, hash string, format string, origin string"


def objects(spark, *texts, form="docx", origins=None):
    rows = [(1, i, "paragraph", t, form, o) for i, (t, o) in enumerate(zip(texts, origins or [None] * len(texts), strict=True))]
    return spark.createDataFrame(rows, OBJECT)


def changes(diff):
    return sorted((r["change"], r["source_place"], r["target_place"], r["basis"]) for r in diff.collect())


def test_moved_objects_are_not_lost(spark):
    diff = quality.diff_objects(objects(spark, "gone", "kept", "too"), objects(spark, "kept", "too"))
    assert changes(diff) == [("lost", 0, None, None), ("moved", 1, 0, "content"), ("moved", 2, 1, "content")]
    assert quality.object_budget(diff, 0, listed(spark)).first()["reason"] == "budget-exceeded"
    assert quality.object_budget(diff, 1, listed(spark)).first()["reason"] == "accepted"


def test_a_shared_origin_keeps_occurrences_apart(spark):
    diff = quality.diff_objects(objects(spark, "a", "b", "c", origins=["g"] * 3), objects(spark, "c", "a", origins=["g"] * 2))
    assert [x[:3] for x in changes(diff)] == [("lost", 1, None), ("moved", 0, 1), ("moved", 2, 0)]
    assert diff.where("ambiguous").count() == 0


def test_repeats_are_ambiguous_and_refused(spark):
    diff = quality.diff_objects(objects(spark, *["same"] * 3), objects(spark, *["same"] * 2))
    assert diff.where("change = 'lost'").count() == 1 and diff.where("ambiguous").count() == 2
    assert tuple(quality.object_budget(diff, 100, listed(spark)).first()) == (1, None, False, "uncertain-matching")


def test_an_edit_in_place_is_a_guess(spark):
    diff = quality.diff_objects(objects(spark, "before"), objects(spark, "after"))
    assert changes(diff) == [("edited", 0, 0, "place")]
    assert quality.heading_budget(diff, 5, listed(spark)).first()["reason"] == "uncertain-matching"


@pytest.mark.parametrize(("form", "expected"), [("docx", ["added", "lost"]), ("html", ["retained"])])
def test_other_origins_of_one_format_are_other_objects(spark, form, expected):
    diff = quality.diff_objects(objects(spark, "same", origins=["s1"]), objects(spark, "same", form=form, origins=["s2"]))
    assert [x[0] for x in changes(diff)] == expected


def test_gates_of_objects_fail_closed_without_inventories(spark):
    diff = quality.diff_objects(objects(spark, "x"), objects(spark, "x"))
    listed = spark.createDataFrame([(1, False), (2, True)], "doc_id long, complete boolean")
    assert [tuple(r) for r in quality.object_budget(diff, 0, listed).orderBy("doc_id").collect()] == [(1, None, False, "unavailable"), (2, 0, True, "accepted")]
    empty = objects(spark)
    assert quality.diff_objects(empty, empty).count() == 0


def test_status_state_forgets_what_is_older_than_the_ttl(spark, tmp_path):
    from folioworks.streaming import jobs

    schema = "user_id long, event_type string, ts timestamp"
    # each file is a batch; the late row of 1 comes after the watermark has passed it
    for i, rows in enumerate([[(1, "old", 0), (2, "a", 50)], [(3, "b", 1000), (2, "z", 40)], [(1, "late", 5), (3, "c", 1000)]]):
        at = [(u, e, pd.Timestamp(1_700_000_000 + s, unit="s").to_pydatetime()) for u, e, s in rows]
        spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in jobs.latest_status(stream, "100 seconds").collect()] == [(3, "c")]


def test_errors_of_page_sizes_and_margins(spark):
    page = "doc_id long, page int, width double, height double, margins array<double>"
    a = spark.createDataFrame([(1, 1, 100.0, 200.0, [10.0] * 4), (2, 1, 1.0, 1.0, [1.0] * 4)], page)
    b = spark.createDataFrame([(1, 1, 110.0, 205.0, [10.0, 13.0, 10.0, 10.0])], page)
    first, second = (tuple(r) for r in quality.page_geometry(a, b).orderBy("doc_id").collect())
    assert first == (1, 10.0, 10.0, 3.0, 1.5, True, True)
    assert second == (2, None, None, None, None, False, False)


def test_a_heading_changes_by_its_role(spark):
    """Text and place do not matter; a lost heading does, and a paragraph that becomes one."""
    rows = lambda *r: spark.createDataFrame([(1, *x) for x in r], "doc_id long, place long, kind string, hash string, format string, origin string, role string, box array<double>")
    a = rows((0, "paragraph", "a", "docx", "1", "heading1", [0.0, 1.0]), (1, "paragraph", "b", "docx", "2", "heading2", None), (2, "paragraph", "c", "docx", "3", None, [1.0, 1.0]), (3, "paragraph", "d", "docx", "4", "heading1", None))
    b = rows((0, "paragraph", "edited", "docx", "1", "heading1", [0.0, 2.0]), (1, "paragraph", "b", "docx", "2", "heading3", None), (2, "paragraph", "c", "docx", "3", "heading1", [2.0, 1.0]))
    diff = quality.diff_objects(a, b)
    assert [x[0] for x in changes(diff)] == ["edited", "lost", "resized", "retained"]
    assert tuple(quality.heading_budget(diff, 3, listed(spark)).first()) == (1, 3, True, "accepted")
    assert quality.heading_budget(diff, 2, listed(spark)).first()["reason"] == "budget-exceeded"


def test_tasks_that_are_being_cancelled_are_not_resumed(spark):
    rows = spark.createDataFrame([("queued", "convert"), ("running", "other"), ("cancelling", "convert"), ("done", "convert")], "status string, queue_kind string")
    kinds = spark.createDataFrame([("convert",)], "queue_kind string")
    assert sorted(tuple(r) for r in tasks.recover_tasks(rows, kinds).collect()) == [("interrupted", 1), ("resumed", 1)]


def test_irregular_tables_are_not_cropped(spark):
    cell = lambda t, r, c, off=0.0: (t, r, c, c * 10.0 + off, r * 5.0, c * 10.0 + 9, r * 5.0 + 4)
    rows = [cell(1, r, c) for r in range(2) for c in range(2)] + [cell(2, r, c, 0.5 * r) for r in range(2) for c in range(2)] + [cell(3, 0, 0), cell(3, 1, 1)]
    got = layout.crop_table(spark.createDataFrame(rows, "table_id long, row int, col int, x0 double, y0 double, x1 double, y1 double"), (0, 1), (1, 1)).collect()
    assert sorted((r["table_id"], r["row"], r["col"]) for r in got) == [(1, 0, 0), (1, 1, 0)]


def test_page_orders_hold_for_all_pages_or_none(spark):
    blocks = spark.createDataFrame([(d, p, f"b{p}{k}", k, 4) for d in (1, 2, 3, 4) for p in (0, 1) for k in range(3)], "doc_id long, page int, block_id string, pos long, revision long")
    full = [["b02", "b00", "b01"], ["b10", "b12", "b11"]]
    orders = [(1, 4, p, ids) for p, ids in enumerate(full)] + [(2, 3, p, ids) for p, ids in enumerate(full)] + [(3, 4, 0, full[0])] + [(4, 4, 0, ["b02", "b02", "b01"]), (4, 4, 1, full[1])] + [(9, 4, 0, full[0])]
    orders = spark.createDataFrame(orders, "doc_id long, revision long, page int, block_ids array<string>")
    assert {tuple(r) for r in layout.order_problems(blocks, orders).collect()} == {(2, "other-revision"), (3, "not-a-permutation"), (4, "not-a-permutation"), (9, "unknown-document")}
    got = layout.apply_page_order(blocks, orders).orderBy("doc_id", "page", "pos").collect()
    assert [r["block_id"] for r in got if r["doc_id"] == 1] == [*full[0], *full[1]]
    assert {r["revision"] for r in got if r["doc_id"] == 1} == {5} and {r["revision"] for r in got if r["doc_id"] != 1} == {4}
    assert all(r["block_id"] == f"b{r['page']}{r['pos']}" for r in got if r["doc_id"] != 1)


def test_references_are_texts_or_records(spark):
    kind = "doc_id long, pos long, text string, record struct<authors:array<string>,title:string,year:int>"
    rows = [(1, 0, " Smith. A book ", None), (1, 1, None, (["Ivanov", "Petrov"], "On grids", 2020)), (1, 2, None, None), (1, 3, "", None), (1, 4, None, (None, None, None)), (2, 0, None, None)]
    refs = spark.createDataFrame(rows, kind)
    got = [tuple(r) for r in templates.reference_list(refs, refs.select("doc_id")).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "[1] Smith. A book"), (1, 1, "[2] Ivanov, Petrov On grids 2020"), (1, 3, "[3] "), (1, 4, "[4] "), (2, None, templates.NO_REFERENCES)]


def test_numbered_names_do_not_meet_others(spark):
    names = ["a.pdf", "a.pdf", "a.pdf", "a_2.pdf", "a_4.pdf", "a_2.pdf", "b", "b", "b_2", "c.x.pdf", "c.x.pdf", "a_02.pdf", "a.pdf", None]
    got = naming.rename_plan(spark.createDataFrame(list(enumerate(names)), "doc_id long, name string")).orderBy("doc_id").collect()
    targets = {r["doc_id"]: r["target"] for r in got}
    assert len(set(targets.values())) == len(targets) == len(names) - 1
    assert [targets[i] for i in (0, 1, 2, 12)] == ["a.pdf", "a_3.pdf", "a_5.pdf", "a_6.pdf"]
    assert [targets[i] for i in (3, 5, 6, 7, 8, 9, 10)] == ["a_2.pdf", "a_2_2.pdf", "b", "b_3", "b_2", "c.x.pdf", "c.x_2.pdf"]


def test_difference_hash_of_pages():
    page = np.full((160, 160), 255.0)
    assert helpers.difference_bits(page) == 0
    page[:, :80] = 0  # dark to light: no pixel is lighter than its right neighbour, but for the ringing of the filter
    ramp = np.tile(np.linspace(255, 0, 160), (160, 1))
    assert helpers.difference_bits(ramp) == 2**64 - 1 and helpers.difference_bits(ramp[:, ::-1]) == 0
    assert np.allclose(helpers.resampling(160, 9).sum(axis=1), 1) and (helpers.shrunk(np.full((160, 160), 77.0), 8, 9) == 77).all()
    assert (helpers.shrunk(page, 8, 9)[:, 0] == 0).all() and (helpers.shrunk(page, 8, 9)[:, 8] == 255).all()
    shifted = np.roll(page, 1, axis=1)
    assert (helpers.difference_bits(page) ^ helpers.difference_bits(shifted)).bit_count() <= 16


def test_keys_of_bibtex_past_999_are_whole_in_both(spark, tmp_path):
    """The SQL cut keys to three characters, so the 1000th entry of a library was item100 there."""
    import duckdb

    from folioworks.operators import render

    spark.range(1, 1003).selectExpr("id * 20 AS p_partkey", "'n' AS p_name", "'T' AS p_type", "'b' AS p_brand", "CAST(3 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    ours = {tuple(r) for r in render.QUERIES["render_bibtex"](spark, str(tmp_path)).select("item_pos", "line").collect()}
    theirs = set(con.execute(f"SELECT item_pos, line FROM ({render.SQL['render_bibtex']})").fetchall())
    assert ours == theirs and len(ours) == 1002 and any(line.startswith("@misc{item1002,") for _, line in theirs)


def test_objects_and_exact_texts_are_compared_after_one_exchange(spark):
    kinds = "doc_id long, place long, kind string, hash string, format string, origin string"
    a = spark.createDataFrame([(1, 1, "p", "a", "x", "o1"), (1, 2, "p", "b", "x", None), (1, 3, "p", "b", "x", "o3"), (1, 4, None, "n", "x", None), (None, 1, "p", "a", "x", None)], kinds)
    b = spark.createDataFrame([(1, 1, "p", "z", "x", "o1"), (1, 2, "p", "b", "x", None), (1, 3, "p", "q", "x", "o4"), (1, 4, None, "n", "x", None), (None, 1, "p", "a", "x", None)], kinds)
    diff = quality.diff_objects(a, b)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(diff).count("Exchange hashpartitioning") == 1
    got = sorted(((r["doc_id"], r["source_place"], r["target_place"], r["change"], r["basis"], r["ambiguous"]) for r in diff.collect()), key=repr)
    want = [(1, 1, 1, "edited", "origin", False), (1, 2, 2, "retained", "content", True), (1, 3, None, "lost", None, False), (1, 4, None, "lost", None, False), (1, None, 3, "added", None, False), (1, None, 4, "added", None, False), (None, 1, None, "lost", None, False), (None, None, 1, "added", None, False)]
    assert got == sorted(want, key=repr)
    blocks = "doc_id long, text string"
    gate = quality.exact_text_gate(spark.createDataFrame([(1, "a"), (1, "a"), (2, " "), (3, "b"), (3, "c")], blocks), spark.createDataFrame([(1, "a"), (3, "c"), (3, "b"), (3, "b"), (4, "d")], blocks))
    assert plan(gate).count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in gate.collect()) == [(1, 1, False), (2, 0, True), (3, 0, True)]
