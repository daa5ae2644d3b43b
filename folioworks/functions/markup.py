"""HTML pages and LaTeX sources as flat rows of a tree: sections, paragraphs, lists, tables, pictures, formulas, links.

A row is (pos, kind, location, parent, text, level, target, row, col, row_span, col_span, font).  location is a
path of kinds and numbers below the parent's; pos is the order of beginning.
"""

import re
from html.parser import HTMLParser

COLUMNS = ["pos", "kind", "location", "parent", "text", "level", "target", "row", "col", "row_span", "col_span", "font"]


class Node:
    __slots__ = ("col", "col_span", "counts", "font", "kind", "level", "location", "parent", "parts", "pos", "row", "row_span", "taken", "target")

    def __init__(self, kind: str, pos: int, parent: "Node | None", level=None, target=None):
        self.kind, self.pos, self.level, self.target = kind, pos, level, target
        self.parent = parent.location if parent else None
        n = 0
        if parent:
            n = parent.counts.get(kind, 0)
            parent.counts[kind] = n + 1
        self.location = f"{parent.location}/{kind}[{n}]" if parent else ""
        self.counts, self.parts = {}, []
        self.row = self.col = self.row_span = self.col_span = self.font = None
        self.taken = {}  # of a table: rows that cells above still cover, by column

    def values(self):
        text = " ".join("".join(self.parts).split())
        return (self.pos, self.kind, self.location, self.parent, text, self.level, self.target, self.row, self.col, self.row_span, self.col_span, self.font)


class Tree:
    """Rows in order of beginning; cells find their place in the grid that row and column spans leave."""

    def __init__(self):
        self.root = Node("root", -1, None)
        self.nodes: list[Node] = []

    def add(self, kind: str, parent: Node | None, **how) -> Node:
        node = Node(kind, len(self.nodes), parent or self.root, **how)
        self.nodes.append(node)
        return node

    def add_row(self, table: Node) -> Node:
        node = self.add("row", table)
        node.row = table.counts["row"] - 1
        if node.row:  # what spans covered in the row before
            table.taken = {c: n - 1 for c, n in table.taken.items() if n > 1}
        return node

    def add_cell(self, table: Node, row: Node, row_span: int, col_span: int) -> Node:
        node = self.add("cell", row)
        node.row, node.row_span, node.col_span = row.row, row_span, col_span
        node.col = row.counts.get("next", 0)
        while any(c in table.taken for c in range(node.col, node.col + col_span)):
            node.col += 1
        row.counts["next"] = node.col + col_span
        if row_span > 1:
            row.taken.update({c: row_span for c in range(node.col, node.col + col_span)})
        return node

    def end_row(self, table: Node, row: Node) -> None:
        table.taken.update(row.taken)

    def rows(self):
        return [n.values() for n in self.nodes]


def _whole(text: str | None, most: int) -> int:
    return min(max(int(text), 1), most) if text and text.isdigit() else 1


class _Html(HTMLParser):
    #: Tags whose text is not shown, tags that end an open paragraph, what closes what, most spans.
    HIDDEN = {"script", "style", "head", "template", "noscript"}
    BLOCKS = {"p", "div", "section", "main", "article", "nav", "table", "ul", "ol", "li", "blockquote", "pre", "hr", "form", "h1", "h2", "h3", "h4", "h5", "h6"}
    VOID = {"br", "img", "hr", "meta", "link", "input", "col", "area", "base", "embed", "source", "track", "wbr"}
    ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tr": ({"tr"}, {"table"})}
    MOST_COLUMNS, MOST_ROWS = 1000, 65534

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree, self.open, self.hidden, self.formula = Tree(), [], 0, None

    def nearest(self, *kinds: str) -> Node | None:
        return next((n for _, n, _ in reversed(self.open) if n and (not kinds or n.kind in kinds)), None)

    def end_from(self, index: int) -> None:
        """Ends the open elements from index on."""
        for _, node, _ in reversed(self.open[index:]):
            if node and node.kind == "row" and (table := self.nearest("table")):
                self.tree.end_row(table, node)
            if node is self.formula:
                self.formula = None
        del self.open[index:]

    def end_open(self, tags: set[str], border: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in border:
                return
            if self.open[i][0] in tags:
                self.end_from(i)
                return

    def handle_starttag(self, tag, attrs):
        had = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
        if self.hidden or self.formula:
            return
        if tag in self.BLOCKS:
            self.end_open({"p", "h1", "h2", "h3", "h4", "h5", "h6"}, {"td", "th", "table", "li"})
        if tag in self.ENDS:
            self.end_open(*self.ENDS[tag])
        node, up = None, self.nearest()
        if tag == "section":
            node = self.tree.add("section", up)
        elif tag == "p":
            node = self.tree.add("paragraph", up)
        elif re.fullmatch("h[1-6]", tag):
            node = self.tree.add("heading", up, level=int(tag[1]))
        elif tag == "li":
            node = self.tree.add("list_item", up, level=sum(t in ("ul", "ol") for t, _, _ in self.open))
        elif tag == "table":
            node = self.tree.add("table", up)
        elif tag == "tr" and (table := self.nearest("table")):
            node = self.tree.add_row(table)
        elif tag in ("td", "th") and (row := self.nearest("row")) and (table := self.nearest("table")):
            node = self.tree.add_cell(table, row, _whole(had.get("rowspan"), self.MOST_ROWS), _whole(had.get("colspan"), self.MOST_COLUMNS))
        elif tag == "img":
            self.tree.add("image", up, target=had.get("src")).parts.append(had.get("alt") or "")
        elif tag == "math":
            node = self.formula = self.tree.add("formula", up, target="mathml")
        elif tag == "a" and had.get("href"):
            node = self.tree.add("link", up, target=had["href"])
        elif tag == "br" and up:
            up.parts.append(" ")
        if tag not in self.VOID:
            font = re.search(r"font-family\s*:\s*[\"']?([^;,\"']+)", had.get("style") or "")
            self.open.append((tag, node, font[1].strip() if font else None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.formula and tag != "math":
            return
        border = {"table"} if tag != "table" else set()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.end_from(i)
                return
            if self.open[i][0] in border:
                return

    def handle_data(self, data):
        if self.hidden:
            return
        if self.formula:
            self.formula.parts.append(data)
            return
        for _, node, _ in reversed(self.open):
            if node and node.kind in ("heading", "paragraph", "list_item", "cell", "link"):
                node.parts.append(data)
            if node and node.kind != "link":  # a link's text is its paragraph's too
                break
        if data.strip():
            run = self.tree.add("run", self.nearest())
            run.parts.append(data)
            run.font = next((f for _, _, f in reversed(self.open) if f), None)


def html_tree(html: str | None) -> list[tuple]:
    parser = _Html()
    parser.feed(html or "")
    HTMLParser.close(parser)
    parser.end_from(0)
    return parser.tree.rows()


#: Levels of headings; environments of formulas, tables and lists; commands of references and citations; sizes of pages in points.
LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
MATH = {"equation", "align", "gather", "multline", "displaymath", "math", "eqnarray", "alignat", "flalign"}
TABLES = {"tabular", "tabularx", "longtable", "tabulary"}
LISTS = {"itemize", "enumerate", "description"}
REFS = {"ref", "pageref", "eqref", "autoref", "cref", "nameref", "hyperref"}
CITES = {"cite", "citep", "citet", "parencite", "textcite", "autocite", "footcite"}
SILENT = {"label", "title", "author", "date", "usepackage", "documentclass", "bibliography", "bibliographystyle", "pagestyle", "input", "include", "hline", "vspace", "hspace", "caption*"}
PAPER = {"a4paper": (595.28, 841.89), "letterpaper": (612.0, 792.0), "a5paper": (419.53, 595.28), "legalpaper": (612.0, 1008.0)}
_TEX = re.compile(r"\\(?P<command>[A-Za-z]+\*?)|(?P<math>\$\$?|\\\(|\\\[)|(?P<line>\\\\(?:\[[^\]]*\])?)|\\(?P<sign>.)|(?P<comment>%[^\n]*\n?)|(?P<gap>\n[ \t]*\n\s*)|(?P<mark>[{}&])|(?P<text>[^\\$%{}&\n]+|\n)", re.S)


def _argument(tex: str, at: int, opening: str = "{", closing: str = "}") -> tuple[str | None, int]:
    """The text in braces at a place (after white space) and where it ends; (None, at) if there is none."""
    start = at
    while start < len(tex) and tex[start] in " \t\n":
        start += 1
    if start >= len(tex) or tex[start] != opening:
        return None, at
    depth, i = 0, start
    while i < len(tex):
        if tex[i] == "\\":
            i += 2
            continue
        depth += (tex[i] == opening) - (tex[i] == closing)
        i += 1
        if not depth:
            return tex[start + 1 : i - 1], i
    return tex[start + 1 :], len(tex)


def _plain(tex: str) -> str:
    """Text of an argument without its commands."""
    return re.sub(r"[{}]", "", re.sub(r"\\[A-Za-z]+\*?(\[[^\]]*\])?\s*|[$~]|\\", " ", tex))


class _Latex:
    def __init__(self, tex: str):
        whole = re.search(r"\\begin\{document\}(.*?)(\\end\{document\}|\Z)", tex, re.S)
        self.tex, self.tree = whole[1] if whole else tex, Tree()
        self.stack: list[tuple[str, Node | None]] = []
        self.paragraph = self.item = None
        options = re.search(r"\\documentclass\s*\[([^\]]*)\]", tex)
        self.paper = next((PAPER[o.strip()] for o in (options[1].split(",") if options else ()) if o.strip() in PAPER), None)

    def up(self) -> Node | None:
        return self.item or next((n for _, n in reversed(self.stack) if n), None)

    def say(self, text: str) -> None:
        if not text.strip() and not (self.paragraph or self.item):
            return
        if self.item:
            self.item.parts.append(text)
        else:
            self.inside().parts.append(text)
        if text.strip():
            self.tree.add("run", self.item or self.paragraph).parts.append(text)

    def inside(self) -> Node:
        """The node that inline objects stand in: the open item, or the paragraph, which may begin with one."""
        if not self.item and not self.paragraph:
            self.paragraph = self.tree.add("paragraph", self.up())
        return self.item or self.paragraph

    def formula(self, kind: str, content: str) -> None:
        self.tree.add("formula", self.up() if kind == "display" else self.inside(), target="latex").parts.append(content)

    def table(self, content: str) -> None:
        table = self.tree.add("table", self.up())
        content = re.sub(r"(?<!\\)%[^\n]*\n?|\\(hline|toprule|midrule|bottomrule)\b|\\(cline|cmidrule)(\([^)]*\))?\{[^}]*\}", "", content)
        for line in re.split(r"\\\\(?:\[[^\]]*\])?", content):
            if not line.strip():
                continue
            row = self.tree.add_row(table)
            for part in re.split(r"(?<!\\)&", line):
                wide, high = re.search(r"\\multicolumn\{(\d+)\}\{[^}]*\}", part), re.search(r"\\multirow\{(\d+)\}\{[^}]*\}", part)
                cell = self.tree.add_cell(table, row, _whole(high and high[1], 1000), _whole(wide and wide[1], 1000))
                text = part
                for m in (wide, high):
                    text = text.replace(m[0], "") if m else text
                cell.parts.append(_plain(text))
            self.tree.end_row(table, row)

    def read(self) -> list[tuple]:
        tex, at = self.tex, 0
        while at < len(tex):
            m = _TEX.match(tex, at)
            if not m:
                at += 1
                continue
            at, kind = m.end(), m.lastgroup
            if kind == "command":
                at = self.command(m["command"], at)
            elif kind == "math":
                close = {"$": "$", "$$": "$$", "\\(": "\\)", "\\[": "\\]"}[m["math"]]
                end = tex.find(close, at)
                self.formula("display" if m["math"] in ("$$", "\\[") else "inline", tex[at : end if end >= 0 else len(tex)])
                at = end + len(close) if end >= 0 else len(tex)
            elif kind == "gap":
                self.paragraph = None
            elif kind in ("text", "sign", "line"):
                self.say({"line": " "}.get(kind, m[kind]).replace("~", " "))
        return self.tree.rows()

    def command(self, name: str, at: int) -> int:
        tex, bare = self.tex, name.rstrip("*")
        if bare in ("begin", "end"):
            env, at = _argument(tex, at)
            return self.begin((env or "").rstrip("*"), env or "", at) if bare == "begin" else self.end((env or "").rstrip("*"), at)
        option, at = _argument(tex, at, "[", "]")
        if bare in LEVELS:
            text, at = _argument(tex, at)
            self.paragraph = self.item = None
            node = self.tree.add("heading", None, level=LEVELS[bare])
            node.parts.append(_plain(text or ""))
            self.tree.add("run", node).parts.append(_plain(text or ""))
        elif bare == "item":
            self.paragraph = None
            lists = [n for e, n in self.stack if e in LISTS]
            self.item = self.tree.add("list_item", lists[-1] if lists else None, level=len(lists))
            self.say(_plain(option) + " " if option else "")
        elif bare in ("href", "url"):
            target, at = _argument(tex, at)
            text, at = _argument(tex, at) if bare == "href" else (target, at)
            self.tree.add("link", self.inside(), target=target).parts.append(_plain(text or ""))
            self.say(_plain(text or ""))
        elif bare in REFS or bare in CITES:
            target, at = _argument(tex, at)
            while bare in CITES and target is None and tex[at : at + 1] == "[":
                _, at = _argument(tex, at, "[", "]")
                target, at = _argument(tex, at)
            shown = _argument(tex, at) if bare == "hyperref" else (None, at)
            self.tree.add("citation" if bare in CITES else "link", self.inside(), target=target if bare in CITES else "#" + (option or target or ""))
            at = shown[1]
            self.say(_plain(shown[0] or (target if bare == "hyperref" else "") or ""))
        elif bare == "includegraphics":
            target, at = _argument(tex, at)
            self.tree.add("image", self.up() if not self.paragraph else self.paragraph, target=target)
        elif name in SILENT or bare in SILENT:
            _, at = _argument(tex, at) if bare != "hline" else (None, at)
        return at

    def begin(self, env: str, full: str, at: int) -> int:
        if env in MATH or env in TABLES or env in ("verbatim", "lstlisting", "comment"):
            end = self.tex.find(f"\\end{{{full}}}", at)
            content, after = (self.tex[at:end], end + len(full) + 6) if end >= 0 else (self.tex[at:], len(self.tex))
            if env in MATH:
                self.formula("display", content)
            elif env in TABLES:
                skipped = 0
                for _ in range(2 if env in ("tabularx", "tabulary") else 1):  # width, columns
                    _, skipped = _argument(content, _argument(content, skipped, "[", "]")[1])
                self.paragraph = None
                self.table(content[skipped:])
            elif env != "comment":
                self.paragraph = None
                self.say(content)
                self.paragraph = None
            return after
        self.paragraph = None
        self.stack.append((env, self.tree.add("list", self.up()) if env in LISTS else None))
        if env in LISTS:
            self.item = None
        return _argument(self.tex, at, "[", "]")[1]

    def end(self, env: str, at: int) -> int:
        opened = [e for e, _ in self.stack]
        if env in opened:
            del self.stack[len(opened) - 1 - opened[::-1].index(env) :]
            self.paragraph = self.item = None
        return at


def latex_tree(tex: str | None) -> tuple[list[tuple], tuple[float, float] | None]:
    """Rows of a LaTeX source, and the page's width and height where the class names its paper."""
    reader = _Latex(tex or "")
    return reader.read(), reader.paper
