"""Trees of HTML pages and LaTeX sources, their counts, and what a comparison of them says."""

import base64

import pyarrow as pa
import pytest

from folioworks.functions import markup
from folioworks.operators import inventory, quality

PNG = base64.b64encode(b"\x89PNG\r\n\x1a\nfakepixelbytes").decode("ascii")
PAGE = f"""<!doctype html><html lang="ru"><head><title>Page</title><style>body {{ font-family: Arial }}</style></head>
<body><section><main><h1 style="font-family:'Cambria Math'">Заголовок</h1>
<p>Первый абзац с <a href="https://example.com">ссылкой</a> и <a href="#bookmark">внутренней</a>.</p>
<table><tbody><tr><td>Ячейка 1</td><td>Ячейка 2</td></tr></tbody></table>
<p><img src="data:image/png;base64,{PNG}" alt="pic"></p>
<p><span><math xmlns="http://www.w3.org/1998/Math/MathML"><mi>x</mi></math></span></p></main></section></body></html>"""
SOURCE = r"""\documentclass[12pt,a4paper]{article}
\title{Документ}
\begin{document}
\section{Введение}
Текст введения с формулой $x^2 + y^2 = z^2$.

\subsection{Раздел}
\href{https://example.com}{Ссылка} и цитата \cite{key1}.

\begin{equation}
E = mc^2
\end{equation}

\begin{itemize}
\item Первый пункт
\item Второй пункт
\end{itemize}

\begin{tabular}{|l|l|}
\hline
A & B \\
\hline
\end{tabular}

Картинка: \includegraphics[width=3cm]{figure.png}.
\end{document}
"""


def metrics(parts):
    return {r["metric"]: r["value"] for r in inventory.inventory_metrics(parts).collect()}


def html(spark, *pages):
    return inventory.html_inventory(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_metrics_of_a_page(spark):
    got = metrics(html(spark, PAGE))
    want = {"sections": 1, "headings": 1, "paragraphs": 3, "tables": 1, "table_rows": 1, "table_cells": 2, "merged_cells": 0, "images": 1, "formulas": 1, "hyperlinks": 1, "internal_hyperlinks": 1, "font:Cambria Math": 1, "formula:mathml": 1}
    assert {k: got[k] for k in want} == want
    assert got["characters"] == len("Заголовок" "Первый абзац с ссылкой и внутренней." "Ячейка 1" "Ячейка 2") and got["text_runs"] == 8


def test_metrics_of_a_latex_source(spark):
    parts = inventory.latex_inventory(spark.createDataFrame([(1, SOURCE)], "doc_id long, text string"))
    got = metrics(parts)
    want = {"pages": 1, "headings": 2, "tables": 1, "images": 1, "formulas": 2, "hyperlinks": 1, "internal_hyperlinks": 0, "citations": 1, "list_items": 2, "formula:latex": 2, "table_rows": 1, "table_cells": 2}
    assert {k: got[k] for k in want} == want and got["paragraphs"] == 3
    assert parts.where("kind = 'page'").first()["text"] == "595.28 841.89"


@pytest.mark.parametrize(
    ("tex", "kinds"),
    [
        (r"50\% of \$5 % a comment" + "\nnext", [("paragraph", "50% of $5 next")]),
        (r"\begin{align*}a &= b \\ c\end{align*}", [("formula", r"a &= b \\ c")]),
        (r"a \[ x \] b \(y\) $$z$$", [("paragraph", "a b"), ("formula", "x"), ("formula", "y"), ("formula", "z")]),
        (r"\begin{verbatim}$no \item$\end{verbatim}", [("paragraph", r"$no \item$")]),
        (r"\textbf{bold {inner}} text~here", [("paragraph", "bold inner text here")]),
        (r"see \cite[p.~3]{a,b} and \citep[see][ch. 2]{c} \ref{x}\url{http://u/_a}", [("paragraph", "see and http://u/_a"), ("citation", ""), ("citation", ""), ("link", ""), ("link", "http://u/_a")]),
        (r"\begin{itemize}\item a \begin{enumerate}\item[2.] b\end{enumerate}\item c\end{itemize} after", [("list", ""), ("list_item", "a"), ("list", ""), ("list_item", "2. b"), ("list_item", "c"), ("paragraph", "after")]),
        (r"\section*{Open {x}", [("heading", "Open x")]),
        (r"\begin{equation} never ends", [("formula", "never ends")]),
        (r"\end{itemize} \unknown{kept} \\[2pt] {", [("paragraph", "kept")]),
        ("", []), (None, []), ("\\", []), ("$", [("paragraph", ""), ("formula", "")]),
    ],
)
def test_latex_parts(tex, kinds):
    rows = [dict(zip(markup.COLUMNS, r, strict=True)) for r in markup.latex_tree(tex)[0]]
    assert [(r["kind"], r["text"]) for r in rows if r["kind"] != "run"] == [(k, t) for k, t in kinds]


def test_cells_stand_in_the_grid_that_spans_leave():
    page = "<table><tr><td rowspan=3>a<td colspan=2>b<td>c<tr><td>d<td rowspan=2>e<tr><td>f<td>g<tr><td>h</table>"
    cells = {r[4]: (r[7], r[8]) for r in markup.html_tree(page) if r[1] == "cell"}
    assert cells == {"a": (0, 0), "b": (0, 1), "c": (0, 3), "d": (1, 1), "e": (1, 2), "f": (2, 1), "g": (2, 3), "h": (3, 0)}
    tex = r"\begin{tabular}{lll}\multirow{2}{*}{a} & \multicolumn{2}{l}{b} \\ & c & d \\\end{tabular}"
    assert [(r[7], r[8], r[9], r[10]) for r in markup.latex_tree(tex)[0] if r[1] == "cell"] == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1)]


def test_loose_html():
    texts = [(r[1], r[4]) for r in markup.html_tree("<p>one<p>two &amp; <b>three<script>no()</script><!-- no --><ul><li>x<ul><li>y</ul><li>z</ul></p></div>tail") if r[1] != "run"]
    assert texts == [("paragraph", "one"), ("paragraph", "two & three"), ("list_item", "x"), ("list_item", "y"), ("list_item", "z")]
    nested = {r[2]: r[3] for r in markup.html_tree("<table><tr><td><p>Cell text<img src=a></p><table><tr><td><p>Deep</table></table>")}
    assert all(parent == "" or parent in nested for parent in nested.values())
    assert markup.html_tree(None) == [] and markup.html_tree("<td>x") and markup.html_tree("</p></table><tr>") == []


NESTED = "<table><tr><td><p>Cell text<img src='picture'><math>x+1</math></p><table><tr><td><p>Deep text</p></td></tr></table></td></tr></table>"


def test_nested_objects_are_listed_and_compared_one_by_one(spark):
    listed = spark.createDataFrame([(0, True)], "doc_id long, complete boolean")
    objects = lambda page: inventory.inventory_objects(html(spark, page), "html")
    whole = objects(NESTED)
    assert [r["kind"] for r in whole.orderBy("place").collect()] == ["table", "paragraph", "image", "formula", "table", "paragraph"]
    by = {r["kind"]: r["text_characters"] for r in whole.where("place < 9").collect()}
    assert by["paragraph"] == len("Cell text") and by["formula"] is None
    lost = lambda page: sorted(r["kind"] for r in quality.diff_objects(whole, objects(page)).where("change = 'lost'").collect())
    assert lost(NESTED.replace("<img src='picture'>", "")) == ["image"]
    assert lost("") == ["formula", "image", "paragraph", "paragraph", "table", "table"]
    gone = quality.diff_objects(whole, objects(""))
    assert quality.object_budget(gone, 5, listed).first()["reason"] == "budget-exceeded"


def test_edits_are_told_apart_from_losses(spark):
    objects = lambda page: inventory.inventory_objects(html(spark, page), "html")
    whole = objects(NESTED)
    for text, less in (("Cell", 5), ("Other txt", 0)):
        target = objects(NESTED.replace("Cell text", text))
        diff = quality.diff_objects(whole, target)
        assert diff.where("change = 'lost'").count() == 0
        assert tuple(inventory.content_changes(diff, whole, target).first()) == (0, 1, less)


def test_losses_by_metric(spark):
    a, b = (inventory.inventory_metrics(html(spark, *p)) for p in ((PAGE, "<p>x</p>"), (PAGE.replace("<img", "<x"), "<p>xy</p>")))
    got = inventory.with_losses(quality.compare_metrics(a, b)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, True, "images"), (1, False, "")]


def test_sources_are_read_once_and_a_few_at_a_time(spark):
    parts = inventory.latex_inventory(spark.createDataFrame([(1, SOURCE)], "doc_id long, text string"))
    assert inventory.inventory_metrics(parts)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "source": [PAGE] * 999 + [None]})
    sizes = [b.column("doc_id").to_pylist() for b in inventory._parts_of(markup.html_tree)([batch])]
    assert max(len(set(ids)) for ids in sizes) <= inventory.AT_ONCE and len({i for ids in sizes for i in ids}) == 999
