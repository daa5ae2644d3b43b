"""Recognised words and pages: clean-up, lines, confidence, regions, order, roles and table grids."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.inputs import derived, plain, table

#: A word's level, the gap and overlap that join words to a line, tolerance of a grid.
WORD_LEVEL, LEAST_OVERLAP, MOST_GAP, TOLERANCE = 5, -2.0, 4.0, 0.1
#: Cells of tables in one task, about.
CELLS_IN_TASK = 250_000
#: Share of a page that is a margin or band, ink that fills a band, densities of edges of a table, width over height of a wide page.
MARGIN, BAND_INK, TABLE_DENSITY, WIDE = 0.08, 0.02, (0.15, 0.4), 1.15


def normalize_words(raw: DataFrame, scale: float) -> DataFrame:
    """Word rows that are not blank, with confidence from 0 to 1 and boxes in page units."""
    rows = raw.where((F.col("level") == WORD_LEVEL) & (F.trim("text") != ""))
    left, top = F.col("left") / scale, F.col("top") / scale
    return rows.select("page_id", "word_id", F.trim("text").alias("text"), left.alias("x0"), top.alias("y0"), ((F.col("left") + F.col("width")) / scale).alias("x1"), ((F.col("top") + F.col("height")) / scale).alias("y1"), F.greatest(F.lit(0.0), F.col("conf") / 100).alias("confidence"))


def polygon_box(polygons: DataFrame) -> DataFrame:
    """The upright box around polygon points (xs, ys)."""
    return polygons.select("page_id", "word_id", F.array_min("xs").alias("x0"), F.array_min("ys").alias("y0"), F.array_max("xs").alias("x1"), F.array_max("ys").alias("y1"))


def fold_lines(words: list[tuple]) -> list[tuple]:
    """(text, x0, y0, x1, y1, confidence) rows of a page to lines: in order of top and left, a word joins the line so far if they overlap in height and are close. The confidence of the line so far counts as much as that of the word that joins."""
    lines: list[list] = []
    for text, x0, y0, x1, y1, conf in sorted(words, key=lambda w: (w[2], w[1], w[0])):
        if lines:
            line = lines[-1]
            if min(line[4], y1) - max(line[2], y0) > LEAST_OVERLAP and x0 - line[3] <= MOST_GAP:
                lines[-1] = [f"{line[0]} {text}", min(line[1], x0), min(line[2], y0), max(line[3], x1), max(line[4], y1), (line[5] + conf) / 2]
                continue
        lines.append([text, x0, y0, x1, y1, conf])
    return [tuple(x) for x in lines]


def merge_lines(words: DataFrame) -> DataFrame:
    """page_id, line, text, box and confidence; the fold depends on order, so a page is one small group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lines = fold_lines([*pdf[["text", "x0", "y0", "x1", "y1", "confidence"]].itertuples(index=False, name=None)])
        out = pd.DataFrame(lines, columns=["text", "x0", "y0", "x1", "y1", "confidence"])
        out.insert(0, "line", range(len(out)))
        out.insert(0, "page_id", key[0])
        return out

    return words.groupBy("page_id").applyInPandas(run, "page_id long, line long, text string, x0 double, y0 double, x1 double, y1 double, confidence double")


def ocr_confidence(raw: DataFrame) -> DataFrame:
    """Mean confidence of a page from 0 to 1; -1 marks rows without one."""
    return raw.groupBy("page_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("conf") != -1, F.col("conf"))) / 100, F.lit(0.0)) + 1e-9, 4).alias("confidence"))


def page_regions(stats: DataFrame) -> DataFrame:
    """Regions of a page (kind, x, y, w, h, confidence) from its size in pixels, the shares of ink in its top and bottom bands and its density of edges.

    A band with ink is a header or footer; a middling density of edges is a table in the
    upper part of the body; the rest is text, in two columns on a wide page; a footer has
    a page number at its right end.
    """
    whole = lambda c: F.floor(c).cast("int")
    w, h = F.col("width"), F.col("height")
    margin, band = whole(w * MARGIN), whole(h * MARGIN)
    header, footer = F.col("top_ink") > BAND_INK, F.col("bottom_ink") > BAND_INK
    table = (F.col("edge_density") > TABLE_DENSITY[0]) & (F.col("edge_density") < TABLE_DENSITY[1])
    top = F.when(header, band).otherwise(0)
    bottom = F.when(footer, h - band).otherwise(h)
    body = F.greatest(F.lit(1), bottom - top)
    wide = w > h * WIDE
    rows = stats.select("page_id", "top_ink", "bottom_ink", header.alias("header"), footer.alias("footer"), table.alias("table"), wide.alias("wide"), w.alias("w"), h.alias("h"), margin.alias("margin"), band.alias("band"), top.alias("top"), bottom.alias("bottom"), body.alias("body"))
    rows = rows.withColumns({"table_top": F.col("top") + whole(F.col("body") * 0.1), "table_height": whole(F.col("body") * 0.3)})
    text_top = F.when(F.col("table"), F.col("table_top") + F.col("table_height")).otherwise(F.col("top"))
    rows = rows.withColumns({"text_top": text_top, "text_height": F.col("bottom") - text_top, "inner": F.col("w") - 2 * F.col("margin"), "column": whole((F.col("w") - 3 * F.col("margin")) / 2)})
    zero, c = F.lit(0), F.col

    def region(when: Column, kind: str, x: Column, y: Column, rw: Column, rh: Column, sure: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), rw.cast("int").alias("w"), rh.cast("int").alias("h"), sure.cast("double").alias("confidence")))

    ink = lambda k: F.round(F.least(F.lit(1.0), c(k) * 10), 2)
    found = F.array(
        region(c("header"), "header", zero, zero, c("w"), c("band"), ink("top_ink")),
        region(c("footer"), "footer", zero, c("h") - c("band"), c("w"), c("band"), ink("bottom_ink")),
        region(c("table"), "table", c("margin"), c("table_top"), c("inner"), c("table_height"), F.lit(0.4)),
        region(~c("wide"), "text", c("margin"), c("text_top"), c("inner"), c("text_height"), F.lit(0.5)),
        region(c("wide"), "text", c("margin"), c("text_top"), c("column"), c("text_height"), F.lit(0.5)),
        region(c("wide"), "text", 2 * c("margin") + c("column"), c("text_top"), c("column"), c("text_height"), F.lit(0.5)),
        region(c("footer"), "page_number", c("w") - c("margin"), c("h") - c("band"), whole(c("margin") / 2), c("band"), F.lit(0.3)),
    )
    return rows.select("page_id", F.explode(F.array_compact(found)).alias("r")).select("page_id", "r.*")


def apply_order(blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """Blocks in a new order (doc_id, revision, block_ids) if it names the present revision and every block once; else as they were."""
    have = blocks.groupBy("doc_id", "revision").agg(F.array_sort(F.collect_list("block_id")).alias("ids"))
    valid = orders.join(have, ["doc_id", "revision"]).where(F.array_sort("block_ids") == F.col("ids"))
    places = valid.select("doc_id", F.posexplode("block_ids").alias("new_pos", "block_id"))
    return blocks.join(places, ["doc_id", "block_id"], "left").select("doc_id", "block_id", F.coalesce(F.col("new_pos").cast("long"), F.col("pos")).alias("pos"), F.col("new_pos").isNotNull().alias("reordered"))


def _judged_orders(blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """doc_id, problem (null: the new order holds) of every document that an order names."""
    have = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("block_id")).alias("ids"))
    asked = orders.select("doc_id", "page", "block_ids")
    same = F.coalesce(F.array_sort("block_ids") == F.col("ids"), F.lit(False))
    pages = have.join(orders.select("doc_id").distinct(), "doc_id", "left_semi").join(asked, ["doc_id", "page"], "full").groupBy("doc_id").agg(F.bool_and(same).alias("same"))
    named = orders.groupBy("doc_id").agg(F.min("revision").alias("least"), F.max("revision").alias("most"))
    stored = blocks.groupBy("doc_id").agg(F.max("revision").alias("revision"))
    both = named.join(stored, "doc_id", "left").join(pages, "doc_id", "left")
    present = (F.col("least") == F.col("revision")) & (F.col("most") == F.col("revision"))
    problem = F.when(F.col("revision").isNull(), "unknown-document").when(~F.coalesce(present, F.lit(False)), "other-revision").when(~F.col("same"), "not-a-permutation")
    return both.select("doc_id", problem.alias("problem"))


def apply_page_order(blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block_id, pos, revision) in new orders (doc_id, revision, page, block_ids): all pages of a document or none.

    An order holds if it names the stored revision and gives, for every page of the
    document and for no other, each of its blocks once; the document's revision rises by
    one then.  Else its blocks stay as they were (see order_problems).
    """
    good = _judged_orders(blocks, orders).where("problem is null").select("doc_id", F.lit(True).alias("good"))
    places = orders.select("doc_id", "page", F.posexplode("block_ids").alias("new_pos", "block_id"))
    moved = blocks.join(good, "doc_id", "left").join(places, ["doc_id", "page", "block_id"], "left")
    pos = F.when(F.col("good"), F.col("new_pos").cast("long")).otherwise(F.col("pos"))
    return moved.select("doc_id", "page", "block_id", pos.alias("pos"), (F.col("revision") + F.coalesce(F.col("good").cast("int"), F.lit(0))).cast("long").alias("revision"))


def order_problems(blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """doc_id, problem of the orders that do not hold: unknown-document, other-revision, not-a-permutation."""
    return _judged_orders(blocks, orders).where("problem is not null")


def apply_roles(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """New roles of text blocks; a document's changes all apply or none does."""
    roles = ["paragraph", "heading1", "heading2", "heading3"]
    checked = changes.join(blocks.select("doc_id", "block_id", "is_text"), ["doc_id", "block_id"], "left").withColumn("ok", F.col("role").isin(roles) & F.coalesce("is_text", F.lit(False)))
    good = checked.groupBy("doc_id").agg(F.bool_and("ok").alias("all_ok")).where("all_ok").select("doc_id")
    new = changes.join(good, "doc_id", "left_semi").groupBy("doc_id", "block_id").agg(F.max("role").alias("new_role"))
    return blocks.join(new, ["doc_id", "block_id"], "left").select("doc_id", "block_id", F.coalesce("new_role", "role").alias("role"))


def tasks_of(cells: DataFrame, in_task: int = CELLS_IN_TASK) -> int:
    """How many tasks it takes if each holds about in_task cells."""
    return max(1, -(-cells.count() // in_task))


def table_grid(cells: DataFrame, tolerance: float = TOLERANCE, tasks: int | None = None) -> DataFrame:
    """table_id, rows, columns, box, and whether the cells (row, col from 0) are a regular grid.

    That is: every place has one cell with a box of positive size, whose left and right
    lie within the tolerance of those of the first cell of its column, and whose top and
    bottom within that of the first cell of its row.  Tables are dealt to as many tasks as
    their cells need (or to `tasks`; 0: they are dealt by table_id already), so what a task
    sorts does not grow with the input.
    """
    cells = cells if tasks == 0 else cells.repartition(tasks or tasks_of(cells), "table_id")
    column, row = W.partitionBy("table_id", "col").orderBy("row"), W.partitionBy("table_id", "row").orderBy("col")
    off = F.greatest(*(F.abs(F.col(c) - F.first(c).over(w)) for c, w in (("x0", column), ("x1", column), ("y0", row), ("y1", row))))
    sound = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & (off <= tolerance)
    checked = cells.withColumn("sound", F.coalesce(sound, F.lit(False)))
    found = checked.groupBy("table_id").agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
        F.bool_and("sound").alias("sound"), F.count("*").alias("n"), F.count_distinct("row", "col").alias("places"),
    )
    full = (F.col("n") == F.col("places")) & (F.col("n") == F.col("rows") * F.col("columns"))
    return found.select("table_id", "rows", "columns", "x0", "y0", "x1", "y1", (full & F.col("sound")).alias("regular"))


def crop_table(cells: DataFrame, rows: tuple[int, int], columns: tuple[int, int], tasks: int | None = None) -> DataFrame:
    """The cells of a range of rows and columns (both ends included), numbered from 0; tables that are no regular grid, or that the range goes beyond, are left out.

    Cells are dealt as in table_grid, once: they meet their table where they are.
    """
    for low, high in (rows, columns):
        if low < 0 or high < low:
            raise ValueError(f"{low} to {high} is no range")
    cells = cells if tasks == 0 else cells.repartition(tasks or tasks_of(cells), "table_id")
    fits = table_grid(cells, tasks=0).where(F.col("regular") & (F.col("rows") > rows[1]) & (F.col("columns") > columns[1])).select("table_id")
    inside = cells.where(F.col("row").between(*rows) & F.col("col").between(*columns)).join(fits, "table_id", "left_semi")
    return inside.withColumns({"row": F.col("row") - rows[0], "col": F.col("col") - columns[0]})


WORDS = "SELECT CAST(l_orderkey % 700 AS BIGINT) AS page_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS word_id, CASE l_linenumber % 7 WHEN 6 THEN '  ' ELSE 'w' || CAST(l_partkey % 90 AS STRING) END AS text, CAST(CASE WHEN l_suppkey % 9 = 0 THEN 4 ELSE 5 END AS INT) AS level, CAST(l_partkey % 300 AS DOUBLE) AS left, CAST(l_suppkey % 40 AS DOUBLE) * 12 AS top, CAST(20 + l_partkey % 30 AS DOUBLE) AS width, 10.0E0 AS height, CAST(CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE l_partkey % 101 END AS DOUBLE) AS conf FROM {lineitem}"
STATS = "SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 1403 ELSE 997 END AS INT) AS width, CAST(1189 + page_id % 7 AS INT) AS height, CAST(page_id % 5 AS DOUBLE) / 64 AS top_ink, CAST(page_id % 8 AS DOUBLE) / 128 AS bottom_ink, CAST(page_id % 16 AS DOUBLE) / 32 AS edge_density FROM {pages}"
BLOCKS = "SELECT conv_id AS doc_id, turn AS block_id, turn AS pos, CAST(conv_id % 3 AS BIGINT) AS revision, role <> 'system' AS is_text, 'paragraph' AS role FROM {conversations}"
PAGED = "SELECT conv_id AS doc_id, CAST(turn % 2 AS INT) AS page, turn AS block_id, turn AS pos, CAST(conv_id % 3 AS BIGINT) AS revision FROM {conversations}"
ROLES = "SELECT conv_id AS doc_id, turn AS block_id, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'title' ELSE 'heading' || CAST(1 + turn % 3 AS STRING) END AS role FROM {conversations} WHERE turn < 3"
CELLS = "SELECT o_orderkey AS table_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, c * 50.0E0 + CASE WHEN o_orderkey % 7 = 0 AND r = 1 AND c = 1 THEN 0.3E0 WHEN o_orderkey % 11 = 0 AND r = 2 THEN 0.05E0 ELSE 0.0E0 END AS x0, r * 20.0E0 AS y0, c * 50.0E0 + CASE WHEN o_orderkey % 13 = 0 AND r = 0 THEN 0.0E0 ELSE 49.0E0 END AS x1, r * 20.0E0 + 19 AS y1 FROM {orders}, (SELECT l_linenumber - 1 AS r FROM {lineitem} GROUP BY l_linenumber) a, (SELECT l_linenumber - 1 AS c FROM {lineitem} GROUP BY l_linenumber) b WHERE r < 2 + o_orderkey % 2 AND c < 3 AND NOT (o_orderkey % 5 = 0 AND r = 1 AND c = 0)"


def _cells(s, d):
    """Cells of up to three rows and columns for each order; orders are dealt before they become cells, and cells stay where their order is."""
    orders = table(s, d, "orders").select("o_orderkey")
    return s.sql(CELLS, orders=orders.repartition(tasks_of(orders, CELLS_IN_TASK // 9), "o_orderkey"), lineitem=table(s, d, "lineitem"))


def _orders(s, d):
    rows = derived(s, d, BLOCKS, "conversations")
    ids = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("block_id"), asc=False).alias("block_ids"))
    return ids.select("doc_id", F.lit(1).cast("long").alias("revision"), F.when(F.col("doc_id") % 4 == 0, F.slice("block_ids", 1, 1)).otherwise(F.col("block_ids")).alias("block_ids"))


def _page_orders(s, d):
    """Every page turned round; of every fifth document the last page short, and orders for documents that there are not."""
    ids = derived(s, d, PAGED, "conversations").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("block_id"), asc=False).alias("block_ids"))
    short = (F.col("doc_id") % 5 == 0) & (F.col("page") == 0)
    known = ids.select("doc_id", F.lit(1).cast("long").alias("revision"), "page", F.when(short, F.array_remove("block_ids", 0)).otherwise(F.col("block_ids")).alias("block_ids"))
    return known.union(known.where("page = 0").withColumn("doc_id", -1 - F.col("doc_id")))


_BL, _RO, _WO = (plain(x, t) for x, t in ((BLOCKS, "conversations"), (ROLES, "conversations"), (WORDS, "lineitem")))
_CE = plain(CELLS, "orders", "lineitem")
_REGIONS = f"""
WITH p AS (SELECT *, (width * 0.08::DOUBLE)::DOUBLE AS m, (height * 0.08::DOUBLE)::DOUBLE AS b, top_ink > 0.02 AS hd, bottom_ink > 0.02 AS ft, edge_density > 0.15 AND edge_density < 0.4 AS tb, width > height * 1.15::DOUBLE AS wide FROM ({plain(STATS, 'pages')})),
q AS (SELECT * REPLACE (floor(m)::INT AS m, floor(b)::INT AS b) FROM p), r AS (SELECT *, CASE WHEN hd THEN b ELSE 0 END AS t, CASE WHEN ft THEN height - b ELSE height END AS e FROM q),
s AS (SELECT *, t + floor((e - t) * 0.1::DOUBLE)::INT AS tt, floor((e - t) * 0.3::DOUBLE)::INT AS th FROM r), u AS (SELECT *, CASE WHEN tb THEN tt + th ELSE t END AS y, (width - 3 * m) // 2 AS cw FROM s)
SELECT page_id, 'header' AS kind, 0 AS x, 0 AS y, width AS w, b AS h, round(least(1.0, top_ink * 10), 2)::DOUBLE AS confidence FROM u WHERE hd
UNION ALL SELECT page_id, 'footer', 0, height - b, width, b, round(least(1.0, bottom_ink * 10), 2)::DOUBLE FROM u WHERE ft
UNION ALL SELECT page_id, 'table', m, tt, width - 2 * m, th, 0.4 FROM u WHERE tb
UNION ALL SELECT page_id, 'text', m, y, CASE WHEN wide THEN cw ELSE width - 2 * m END, e - y, 0.5 FROM u
UNION ALL SELECT page_id, 'text', 2 * m + cw, y, cw, e - y, 0.5 FROM u WHERE wide
UNION ALL SELECT page_id, 'page_number', width - m, height - b, m // 2, b, 0.3 FROM u WHERE ft
"""

QUERIES = {
    "normalize_words": lambda s, d: normalize_words(derived(s, d, WORDS, "lineitem"), 2.0),
    "merge_lines": lambda s, d: merge_lines(normalize_words(derived(s, d, WORDS, "lineitem"), 2.0)),
    "ocr_confidence": lambda s, d: ocr_confidence(derived(s, d, WORDS, "lineitem")),
    "page_regions": lambda s, d: page_regions(derived(s, d, STATS, "pages")),
    "apply_order": lambda s, d: apply_order(derived(s, d, BLOCKS, "conversations"), _orders(s, d)),
    "apply_page_order": lambda s, d: apply_page_order(derived(s, d, PAGED, "conversations"), _page_orders(s, d)),
    "order_problems": lambda s, d: order_problems(derived(s, d, PAGED, "conversations"), _page_orders(s, d)),
    "apply_roles": lambda s, d: apply_roles(derived(s, d, BLOCKS, "conversations"), derived(s, d, ROLES, "conversations")),
    "table_grid": lambda s, d: table_grid(_cells(s, d), tasks=0),
    "crop_table": lambda s, d: table_grid(crop_table(_cells(s, d), (0, 2), (1, 2), tasks=0), tasks=0),
}
_GRID = """
SELECT table_id, max(row) + 1 AS rows, max(col) + 1 AS columns, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  count(*) = count(DISTINCT (row, col)) AND count(*) = (max(row) + 1) * (max(col) + 1) AND bool_and(x0 < x1 AND y0 < y1 AND abs(x0 - cx0) <= 0.1 AND abs(x1 - cx1) <= 0.1 AND abs(y0 - ry0) <= 0.1 AND abs(y1 - ry1) <= 0.1) AS regular
FROM (SELECT *, first_value(x0) OVER c AS cx0, first_value(x1) OVER c AS cx1, first_value(y0) OVER r AS ry0, first_value(y1) OVER r AS ry1 FROM ({}) WINDOW c AS (PARTITION BY table_id, col ORDER BY row), r AS (PARTITION BY table_id, row ORDER BY col))
GROUP BY table_id
"""
SQL = {
    "normalize_words": f"SELECT page_id, word_id, trim(text) AS text, \"left\" / 2 AS x0, top / 2 AS y0, (\"left\" + width) / 2 AS x1, (top + height) / 2 AS y1, greatest(0.0, conf / 100) AS confidence FROM ({_WO}) WHERE level = 5 AND trim(text) <> ''",
    "ocr_confidence": f"SELECT page_id, round(coalesce(avg(conf) FILTER (conf <> -1) / 100, 0.0) + 1e-9, 4) AS confidence FROM ({_WO}) GROUP BY page_id",
    "page_regions": _REGIONS,
    "apply_order": f"SELECT doc_id, block_id, CASE WHEN ok THEN n - 1 - pos_rank ELSE pos END AS pos, ok AS reordered FROM (SELECT *, revision = 1 AND (doc_id % 4 <> 0 OR n = 1) AS ok FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) - 1 AS pos_rank FROM ({_BL})))",
    "apply_page_order": f"SELECT doc_id, page, block_id, CASE WHEN revision = 1 AND doc_id % 5 <> 0 THEN n - 1 - nth ELSE pos END AS pos, revision + (revision = 1 AND doc_id % 5 <> 0)::BIGINT AS revision FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) - 1 AS nth FROM ({plain(PAGED, 'conversations')}))",
    "order_problems": f"SELECT DISTINCT doc_id, CASE WHEN revision <> 1 THEN 'other-revision' ELSE 'not-a-permutation' END AS problem FROM ({plain(PAGED, 'conversations')}) WHERE revision <> 1 OR doc_id % 5 = 0 UNION ALL SELECT DISTINCT -1 - doc_id, 'unknown-document' FROM ({plain(PAGED, 'conversations')}) WHERE page = 0",
    "apply_roles": f"SELECT b.doc_id, b.block_id, coalesce(CASE WHEN g.ok THEN c.role END, b.role) AS role FROM ({_BL}) b LEFT JOIN ({_RO}) c USING (doc_id, block_id) LEFT JOIN (SELECT c.doc_id, bool_and(c.role <> 'title' AND b.is_text) AS ok FROM ({_RO}) c JOIN ({_BL}) b USING (doc_id, block_id) GROUP BY c.doc_id) g ON g.doc_id = b.doc_id",
    "table_grid": _GRID.format(_CE),
    "crop_table": _GRID.format(f"SELECT * REPLACE (col - 1 AS col) FROM ({_CE}) WHERE row <= 2 AND col BETWEEN 1 AND 2 AND table_id IN (SELECT table_id FROM ({_GRID.format(_CE)}) WHERE regular AND rows > 2 AND columns > 2)"),
}
