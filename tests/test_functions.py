"""Cases of single functions, and helpers against brute force."""

from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioworks.functions import helpers, text as T
from folioworks.operators import bibliography, layout, matching, naming, quality, templates
from folioworks.plans.pipeline import Operations, run_pipeline


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_emails(spark):
    got = lambda t: one(spark, T.emails(F.col("t")), t=t)
    assert got("real@example.com fake@example.test") == ["real@example.com"]
    assert got("User@Example.com user@example.com") == ["User@Example.com", "user@example.com"]
    assert got("a@b.toolong a@b.c none") == [] and got(None) == []


def test_text(spark):
    assert one(spark, T.transliterate(F.col("t")), t="Щука и Ёж") == "schuka i yozh"
    assert one(spark, T.normalize_text(F.col("t")), t="  Ａb—c Ё! ") == "ab c ё"
    assert one(spark, T.sanitize_filename(F.col("t")), t='a<b>:"c/') == "a_b_c"


def test_word_edits_over_all_short_sequences():
    def full(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    words = [s for n in range(4) for s in product("ab", repeat=n)]
    for a, b, limit in product(words, words, range(4)):
        d = full(a, b)
        got, low = helpers.word_edits(a, b, limit)
        assert got == (d if d <= limit else None) and low <= d


def test_bibliography(spark):
    raw = "Иванов И.И., Петров П.П. Феррорезонанс в сетях // Электричество. 2020. с. 10-20. doi 10.1234/abc.5."
    df = spark.createDataFrame([(raw,)], "raw_text string")
    c = F.col("raw_text")
    row = df.select(bibliography.authors(c).alias("a"), bibliography.title(c).alias("t"), bibliography.doc_type(c).alias("d"), *(x.alias(n) for n, x in bibliography.identifiers(c).items())).first()
    assert row["a"] == ["Иванов", "Петров"] and row["t"] == "Феррорезонанс в сетях" and row["year"] == 2020
    assert row["pages"] == "10-20" and row["doi"] == "10.1234/abc.5" and row["d"] == "article"


def test_matching_ties_and_manual(spark):
    docs = spark.createDataFrame([(1, "Ferroresonance in power grids is studied by Smith in 2020 " * 3, "a.txt"), (2, "nothing here", "b.txt"), (3, "nothing here", "mine.v2.txt")], "doc_id long, text string, filename string")
    bib = spark.createDataFrame([(1, ["Smith"], "Ferroresonance in Power Grids", 2020, "", ""), (2, ["Smith"], "Ferroresonance in Power Grids", 2020, "", "")], "item_pos long, authors array<string>, title string, year int, doi string, isbn string")
    manual = spark.createDataFrame([("mine.v2", 2), ("b", 99)], "stem string, item_pos long")
    got = {r["doc_id"]: r for r in matching.match_files(docs, bib, manual).collect()}
    assert got[1]["item_pos"] == 1 and got[1]["matched"] and got[1]["score"] == pytest.approx(1.0 + 2.0 + 0.15)
    assert not got[2]["matched"] and got[3]["item_pos"] == 2 and got[3]["score"] == 100


def test_template_without_key_is_refused(spark):
    bib = spark.createDataFrame([(1, ["Smith"], "T", "book")], "item_pos long, authors array<string>, title string, doc_type string")
    with pytest.raises(ValueError):
        naming.build_filename(bib, "{index}_{title}")
    assert naming.build_filename(bib).first()["name"] == "01_книга_Smith_t.pdf"


def test_lines():
    words = [("мир", 21.0, 0.0, 40.0, 10.0, 0.5), ("привет", 0.0, 0.0, 20.0, 10.0, 1.0), ("far", 90.0, 0.0, 99.0, 10.0, 1.0)]
    assert [x[0] for x in layout.fold_lines(words)] == ["привет мир", "far"]


def test_template_errors(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, name string")
    with pytest.raises(ValueError):
        templates.compile_template(["{% if a %}"])
    with pytest.raises(ValueError):
        templates.render_blocks(["{{ nobody }}"], rows)


def test_blank_rasters(spark):
    white, black = [255] * 25600, [0] * 25600
    got = [r for r in quality.compare_rasters(spark.createDataFrame([(1, white, white, 160), (2, black, white, 160)], "pair_id long, ref array<int>, cand array<int>, width int")).orderBy("pair_id").collect()]
    assert got[0]["overlap"] == 1.0 and got[0]["similarity"] == 1.0 and got[1]["overlap"] == 0.0


def test_pipeline_stops_at_the_first_failure():
    ops = Operations()
    ops.register("one", lambda: 1)
    ops.register("bad", lambda x: x / 0)
    with pytest.raises(ValueError):
        ops.register("one", lambda: 2)
    told = []
    out = run_pipeline({"steps": [{"op": "one", "output": "a"}, {"op": "bad", "input": "$a"}, {"op": "one"}]}, ops, told=told.append)
    assert not out["ok"] and [s["status"] for s in out["steps"]] == ["done", "failed"] and told[-1]["kind"] == "step_failed"


def test_blocks_of_a_page():
    page = "<head><title>t</title></head><h2>Head</h2><p>one &amp; two<br>three</p><script>no()</script><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><th>x</th><td>y</td></tr></table>tail"
    assert helpers.page_blocks(page) == [("heading", 2, "Head"), ("paragraph", 0, "one & two three"), ("list_item", 0, "a"), ("list_item", 1, "b"), ("cell", 0, "x"), ("cell", 0, "y"), ("paragraph", 0, "tail")]
    assert helpers.page_blocks(None) == [] and helpers.page_blocks("<p>open<p>two") == [("paragraph", 0, "open"), ("paragraph", 0, "two")]


def test_words_merge_to_lines():
    word = lambda text, x0, x1, y0=0.0, y1=10.0, c=1.0: (text, x0, y0, x1, y1, c)
    assert layout.fold_lines([word("привет", 0.0, 20.0, c=0.8), word("мир", 21.0, 40.0, c=0.6)]) == [("привет мир", 0.0, 0.0, 40.0, 10.0, 0.7)]
    assert [r[0] for r in layout.fold_lines([word("far", 30.0, 40.0), word("near", 0.0, 20.0)])] == ["near", "far"]
    assert [r[0] for r in layout.fold_lines([word("below", 0.0, 20.0, 13.0, 20.0), word("above", 0.0, 20.0)])] == ["above", "below"]
    # a gap of four joins, a little more does not; boxes that are apart by less than two in height still join
    assert len(layout.fold_lines([word("a", 0.0, 10.0), word("b", 14.0, 20.0)])) == 1 and len(layout.fold_lines([word("a", 0.0, 10.0), word("b", 14.1, 20.0)])) == 2
    assert len(layout.fold_lines([word("a", 0.0, 10.0), word("b", 9.0, 20.0, 11.9, 20.0)])) == 1 and len(layout.fold_lines([word("a", 0.0, 10.0), word("b", 9.0, 20.0, 12.0, 20.0)])) == 2
    assert layout.fold_lines([]) == []


def test_cells_of_tables_go_to_as_many_tasks_as_they_need(spark):
    """However little a shuffle holds, a task of a grid or a cropped grid has no more than some cells."""
    cells = spark.range(6000).select(F.expr("id div 6").alias("table_id"), F.expr("cast(id % 6 div 3 as int)").alias("row"), F.expr("cast(id % 3 as int)").alias("col"))
    cells = cells.selectExpr("*", "col * 50.0D as x0", "row * 20.0D as y0", "col * 50.0D + 49 as x1", "row * 20.0D + 19 as y1")
    assert layout.tasks_of(cells, 1000) == 6 and layout.tasks_of(cells.limit(0)) == 1
    grid = layout.table_grid(cells, tasks=7)
    assert grid.rdd.getNumPartitions() == 7 and grid.where("regular").count() == 1000
    cropped = layout.crop_table(cells, (0, 0), (1, 2), tasks=7)
    assert cropped.count() == 2000 and {r["col"] for r in cropped.limit(50).collect()} == {0, 1}
    spread = cropped.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 7 and max(r["count"] for r in spread) < 600


def test_pages_become_rows_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": ["<h2>a</h2><p>b<ul><li>c</ul>"] * 998 + ["", None]})
    got = list(helpers.html_rows([batch, batch.slice(0, 0), batch.slice(998)]))
    assert max(len(set(b.column("page_id").to_pylist())) for b in got) <= 128
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(i, n, *b) for i in range(998) for n, b in enumerate([("heading", 2, "a"), ("paragraph", 0, "b"), ("list_item", 0, "c")])]


def test_a_batch_of_long_texts_is_composed_in_little_memory():
    """Ten thousand texts of 10 kB: Python's own strings are far fewer than the batch at any time."""
    import tracemalloc

    batch = pa.array(["ﬁ" + "é" * 5000] * 9_999 + [None, ""])
    tracemalloc.start()
    got = helpers.composed(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 10_001 and got[0].as_py() == "fi" + "é" * 5000 and got[9_999].as_py() is None and got[10_000].as_py() == ""
    assert peak < 20_000_000 and helpers.composed(batch.slice(0, 0)).to_pylist() == []


def test_references_are_dealt_to_all_cores_and_titles_computed_once(spark, sf):
    rows = bibliography.QUERIES["bib_title"](spark, sf)
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert rows._jdf.queryExecution().analyzed().toString().count("lower(raw_text") == 1
