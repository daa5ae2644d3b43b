"""What HTML pages and LaTeX sources consist of: a flat tree of parts, counts by metric, objects to compare."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..plans.inputs import derived, plain, table

PARTS = "pos int, kind string, location string, parent string, text string, level int, target string, row int, col int, row_span int, col_span int, font string"
#: Kinds of parts that are objects of a document, and kinds whose text counts.
OBJECTS = ["paragraph", "heading", "list_item", "table", "image", "formula"]
TEXTS = ["paragraph", "heading", "list_item", "cell"]
#: Sources that a worker has as rows of parts at once.
AT_ONCE = 128


def html_inventory(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id and the parts of each page: sections, headings, paragraphs, list items, tables, rows, cells, images, formulas, links, text runs.

    location is a path of kinds and numbers, parent that of the part around it; row and
    col are a cell's place in the grid that spans leave; target is a link's or image's
    address, or a formula's notation; font is that of the nearest style.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("source")).mapInArrow(_parts_of(markup.html_tree), f"doc_id {kind}, {PARTS}")


def latex_inventory(sources: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As html_inventory, for LaTeX sources; citations are parts too, and the page is one where the class names its paper (text: width and height in points)."""

    def tree(tex: str | None) -> list[tuple]:
        parts, paper = markup.latex_tree(tex)
        return [*parts, (len(parts), "page", "/page[0]", "", f"{paper[0]} {paper[1]}", *[None] * 7)] if paper else parts

    kind = sources.schema[id_col].dataType.simpleString()
    return sources.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("source")).mapInArrow(_parts_of(tree), f"doc_id {kind}, {PARTS}")


def _parts_of(tree: Callable[[str | None], list[tuple]], at_once: int = AT_ONCE):
    """A mapInArrow function: doc_id, source -> doc_id and the parts of each source, of a few sources at a time."""
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in PARTS.split(", ")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                rows, docs = [], []
                for i, source in enumerate(batch["source"]):
                    found = tree(source.as_py())
                    rows += found
                    docs += [i] * len(found)
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                parts = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(docs, pa.int64())), *parts], ["doc_id", *markup.COLUMNS])

    return run


def inventory_metrics(parts: DataFrame) -> DataFrame:
    """doc_id, metric, value of the parts of each document: sixteen counts, and one for each font (font:NAME) and notation of formulas (formula:NAME).

    Parts are counted by document and name, names then by document, so the sources are read once.
    """
    kind = lambda *ks: F.count_if(F.col("kind").isin(*ks))
    inner = F.col("target").startswith("#")
    named = F.when((F.col("kind") == "run") & F.col("font").isNotNull(), F.concat(F.lit("font:"), "font")).when(F.col("kind") == "formula", F.concat(F.lit("formula:"), "target"))
    counts = [
        kind("section").alias("sections"), kind("heading").alias("headings"), kind("paragraph").alias("paragraphs"), kind("list_item").alias("list_items"), kind("table").alias("tables"),
        kind("row").alias("table_rows"), kind("cell").alias("table_cells"), F.count_if((F.col("kind") == "cell") & ((F.col("row_span") > 1) | (F.col("col_span") > 1))).alias("merged_cells"),
        kind("image").alias("images"), kind("formula").alias("formulas"), F.count_if((F.col("kind") == "link") & ~inner).alias("hyperlinks"), F.count_if((F.col("kind") == "link") & inner).alias("internal_hyperlinks"),
        kind("citation").alias("citations"), kind("page").alias("pages"), kind("run").alias("text_runs"), F.coalesce(F.sum(F.when(F.col("kind").isin(TEXTS), F.length("text"))), F.lit(0)).alias("characters"),
    ]
    by_name = parts.groupBy("doc_id", named.alias("name")).agg(*counts, F.count("*").alias("n"))
    names = [c for c in by_name.columns if c not in ("doc_id", "name", "n")]
    entry = lambda name, value: F.struct(name.alias("metric"), value.alias("value"))
    own = F.collect_list(F.when(F.col("name").isNotNull(), entry(F.col("name"), F.col("n"))))
    wide = by_name.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in names), own.alias("own"))
    return wide.select("doc_id", F.inline(F.concat(F.array(*(entry(F.lit(c), F.col(c)) for c in names)), "own")))


def inventory_objects(parts: DataFrame, form: str) -> DataFrame:
    """The objects of each document as diff_objects takes them: nested ones too, by the order in which they begin; a heading is a paragraph with a role.

    text_characters is null where an object's text is no plain text (formulas, images).
    """
    is_text = F.col("kind").isin(TEXTS)
    role = F.when(F.col("kind") == "heading", F.concat(F.lit("heading"), F.col("level").cast("string")))
    return parts.where(F.col("kind").isin(OBJECTS)).select(
        "doc_id", F.col("pos").cast("long").alias("place"), F.when(F.col("kind") == "heading", "paragraph").otherwise(F.col("kind")).alias("kind"),
        F.sha2(F.concat_ws("\x1f", "kind", "text", F.coalesce("target", F.lit(""))), 256).alias("hash"), F.lit(form).alias("format"), F.lit(None).cast("string").alias("origin"),
        role.alias("role"), "location", "parent", F.when(is_text, F.length("text")).alias("text_characters"),
    )


def content_changes(diff: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, changed_texts, net_reduction: paired objects whose text was edited, and by how many characters all together they are shorter."""
    size = lambda df, side: df.select("doc_id", F.col("place").alias(f"{side}_place"), F.col("text_characters").alias(f"{side}_n"))
    edited = diff.where("change = 'edited'").join(size(source, "source"), ["doc_id", "source_place"]).join(size(target, "target"), ["doc_id", "target_place"])
    edited = edited.where("source_n is not null and target_n is not null")
    return edited.groupBy("doc_id").agg(F.count("*").alias("changed_texts"), F.sum(F.col("source_n") - F.col("target_n")).alias("net_reduction"))


def with_losses(compared: DataFrame) -> DataFrame:
    """doc_id, has_losses, lost: of compared metrics, whether the target has less of any, and of which."""
    lost = F.array_sort(F.collect_list(F.when(F.col("lost"), F.col("metric"))))
    return compared.groupBy("doc_id").agg(F.bool_or("lost").alias("has_losses"), F.array_join(lost, ",").alias("lost"))


#: A LaTeX source for each order: a section, a paragraph with a formula, a link and a citation, a table of its lines, every third with a wide cell, and a list.
SOURCES = r"""
SELECT o_orderkey AS doc_id, r'\documentclass[a4paper]{{article}}' || chr(10) || r'\begin{{document}}' || chr(10) || r'\section{{Order ' || CAST(o_orderkey AS STRING) || '}}' || chr(10) || r'Status \emph{{' || o_orderstatus || r'}} and $x_1$, see \href{{https://e.org}}{{this}} or \ref{{t}} by \cite{{k}}.' || chr(10) || chr(10)
  || r'\begin{{tabular}}{{ll}}' || chr(10) || rows || r'\end{{tabular}}' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN r'\begin{{itemize}}\item one \item two\end{{itemize}}' ELSE r'\includegraphics{{a.png}}' END || chr(10) || r'\end{{document}}' AS text
FROM {orders} JOIN (SELECT l_orderkey, array_join(array_agg(CASE WHEN l_linenumber % 3 = 0 THEN r'\multicolumn{{2}}{{l}}{{wide}}' ELSE l_linestatus || ' & ' || l_returnflag END), r' \\ ') || r' \\ ' AS rows FROM {lineitem} GROUP BY l_orderkey) ON l_orderkey = o_orderkey
"""
_BARE = "regexp_replace(html, '<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->', '', 'gsi')"
_TAGS = {
    "sections": "<section[ >]", "headings": "<h[1-6][ >]", "paragraphs": "<p[ >]", "list_items": "<li[ >]", "tables": "<table[ >]", "table_rows": "<tr[ >]", "table_cells": "<t[dh][ >]", "images": "<img[ />]",
    "hyperlinks": "<a [^>]*href=[\"'']?[^#\"'' >]", "internal_hyperlinks": "<a [^>]*href=[\"'']?#",
}


def _latex(s, d):
    return latex_inventory(derived(s, d, SOURCES, "orders", "lineitem"))


QUERIES = {
    "html_metrics": lambda s, d: inventory_metrics(html_inventory(table(s, d, "pages"))).where(F.col("metric").isin(*_TAGS)),
    "html_objects": lambda s, d: inventory_objects(html_inventory(table(s, d, "pages")), "html").groupBy("kind", "role").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")),
    "latex_metrics": lambda s, d: inventory_metrics(_latex(s, d)).where("metric not in ('characters', 'text_runs') and metric not like 'f%:%'"),
}
SQL = {
    "html_metrics": f"SELECT page_id AS doc_id, unnest([{', '.join(repr(m) for m in _TAGS)}]) AS metric, unnest([{', '.join(f"len(regexp_extract_all(bare, '{p}'))" for p in _TAGS.values())}]) AS value FROM (SELECT page_id, {_BARE} AS bare FROM pages)",
    "latex_metrics": """
        SELECT doc_id, unnest(['sections', 'headings', 'paragraphs', 'list_items', 'tables', 'table_rows', 'table_cells', 'merged_cells', 'images', 'formulas', 'hyperlinks', 'internal_hyperlinks', 'citations', 'pages']) AS metric,
          unnest([0, 1, 1, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END, 1, n, 2 * n - wide, wide, (doc_id % 3 <> 0)::BIGINT, 1, 1, 1, 1, 1]) AS value
        FROM (SELECT l_orderkey AS doc_id, count(*) AS n, count(*) FILTER (l_linenumber % 3 = 0) AS wide FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)""",
}
