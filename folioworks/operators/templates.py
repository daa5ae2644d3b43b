"""Templates over data tables: row validation, variables, filling, blocks, numbered targets, contents, references."""

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scopes, text as T
from ..plans.inputs import derived, plain

#: Prefixes of numbered targets, width of a table of contents and indent of a level.
PREFIX = {"figure": "Рис. ", "table": "Табл. "}
TOC_WIDTH, TOC_INDENT = 72, "    "
#: Bytes of templates that are sent to all tasks.
SENT = 32 << 20
#: Fixed value: the line of a document without references.
NO_REFERENCES = "(список литературы пуст)"
TAG = r"\{%\s*(.*?)\s*%\}"


def kind_errors(name: str, kind: str, value: Column) -> Column:
    """The error of a JSON value (text as get_json_object gives it, kind from json_type) that is not of the declared kind."""
    number = value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    fits = {
        "string": value.startswith('"'), "integer": value.rlike(r"^-?\d+$"), "number": number, "boolean": value.isin("true", "false"),
        "array": value.startswith("["), "object": value.startswith("{"), "image": value.startswith('"'), "formula": value.startswith('"'), "any": F.lit(True),
    }[kind]
    return F.when(value.isNotNull() & ~fits, F.lit(f"{name}: not {kind}"))


class Node:
    """A place in a schema: the field declared there, if any, and the places below it."""

    def __init__(self):
        self.field, self.below = None, {}


def schema_tree(schema: list[dict]) -> Node:
    """The places of dotted names; a name must not come twice."""
    root = Node()
    for f in schema:
        node = root
        for part in f["name"].split("."):
            node = node.below.setdefault(part, Node())
        if node.field:
            raise ValueError(f"{f['name']} is declared twice")
        node.field = f
    return root


def _path(parts: list[str]) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)


def _at(data: Column, parts: list[str]) -> Column:
    return F.try_variant_get(data, _path(parts), "variant") if parts else data


def _is(kind: str, value: Column) -> Column:
    """Whether a value is of a declared kind; true and false are no numbers, pictures and formulas are texts or objects."""
    of = F.schema_of_variant(value)
    is_text, is_object, whole = of == "STRING", of.startswith("OBJECT"), (of == "BIGINT") | of.rlike(r"^DECIMAL\(\d+,0\)$")
    return {
        "any": F.lit(True), "string": is_text, "integer": whole, "number": whole | of.startswith("DECIMAL") | (of == "DOUBLE"), "boolean": of == "BOOLEAN",
        "array": of.startswith("ARRAY"), "object": is_object, "image": is_text | is_object, "formula": is_text | is_object,
    }[kind]


def validate_data(rows: DataFrame, schema: list[dict], allow_extra: bool = True, data: str = "data", most_bytes: int | None = None) -> DataFrame:
    """id, errors (array, in order of the schema), data (JSON with defaults filled in; null where there is an error).

    data is a JSON object as text; the schema has fields of name (a dotted path), type,
    required (true unless said) and default.  A missing value takes its default, also
    inside objects that are missing, which are made; where something on the way is no
    object, that is an error.  A value that is there must be of its kind, null is only of
    kind any.  Without allow_extra, names at the top that no field begins with are errors.
    Texts that are no JSON objects (also those with a name twice), or of more than
    most_bytes, are errors of the whole; 1.0 is an integer.
    """
    given = F.try_parse_json(F.col(data))
    sound = F.coalesce(F.schema_of_variant(given).startswith("OBJECT"), F.lit(False))
    small = F.octet_length(data) <= most_bytes if most_bytes is not None else F.lit(True)
    rows = rows.select("id", F.when(sound & small, given).alias("given"), F.when(~small, "the data are too large").when(~sound, "the data are no object").alias("whole"))
    v, errors = F.col("given"), [F.col("whole")]
    for f in schema:
        name, parts = f["name"], f["name"].split(".")
        value = _at(v, parts)
        missing = value.isNull()
        if "default" in f:
            on_the_way = [(i, _at(v, parts[:i])) for i in range(1, len(parts))]
            for i, way in on_the_way:
                errors.append(F.when(v.isNotNull() & missing & way.isNotNull() & ~F.schema_of_variant(way).startswith("OBJECT"), F.lit(f"{name}: {'.'.join(parts[:i])} is no object")))
        elif f.get("required", True):
            errors.append(F.when(v.isNotNull() & missing, F.lit(f"{name}: missing")))
        errors.append(F.when(~missing & ~_is(f["type"], value), F.lit(f"{name}: not {f['type']}")))
    found = F.array_compact(F.array(*errors))
    if not allow_extra:
        roots = F.array(*(F.lit(r) for r in schema_tree(schema).below)) if schema else F.array().cast("array<string>")
        keys = F.array_sort(F.array_except(F.map_keys(F.expr("cast(given as map<string, variant>)")), roots))
        found = F.concat(found, F.coalesce(F.transform(keys, lambda k: F.concat(k, F.lit(": undeclared"))), F.array().cast("array<string>")))
    filled = F.to_json(_filled(v, schema_tree(schema), []))
    return rows.select("id", found.alias("errors"), filled.alias("made")).select("id", "errors", F.when(F.size("errors") == 0, F.col("made")).alias("data"))


def _has_default(node: Node) -> bool:
    return bool(node.field and "default" in node.field) or any(map(_has_default, node.below.values()))


def _filled(data: Column, node: Node, parts: list[str]) -> Column:
    """The value at a place, with defaults at it and below it; null if there is none."""
    value = _at(data, parts)
    if node.field and "default" in node.field:
        value = F.coalesce(value, F.parse_json(F.lit(json.dumps(node.field["default"]))))
    below = {k: n for k, n in node.below.items() if _has_default(n)}
    if not below:
        return value
    own = F.coalesce(F.try_variant_get(value, "$", "map<string, variant>"), F.expr("cast(map() as map<string, variant>)"))
    own = F.map_filter(own, lambda k, _: ~k.isin(*below))
    # a default given for this place is looked into as well
    inner = {k: _filled(value, n, [k]) for k, n in below.items()}
    made = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in inner.items())), lambda e: e["value"].isNotNull()))
    return F.when(value.isNull() | F.schema_of_variant(value).startswith("OBJECT"), F.parse_json(F.to_json(F.map_concat(own, made)))).otherwise(value)


def validate_rows(rows: DataFrame, schema: list[dict], data: str = "data") -> DataFrame:
    """id, errors, data of rows whose values (map<string,string> of JSON texts) are checked against a schema of name, type, required, default.

    Missing optional values take their default; all errors of a row are listed: missing
    required values, wrong types (true and false are no numbers), undeclared names.
    """
    names = [f["name"] for f in schema]
    value = {f["name"]: F.coalesce(F.col(data)[f["name"]], F.lit(json.dumps(f["default"]) if "default" in f else None).cast("string")) for f in schema}
    errors = [F.when(value[f["name"]].isNull(), F.lit(f"{f['name']}: missing")) for f in schema if f.get("required")]
    errors += [kind_errors(f["name"], f["type"], value[f["name"]]) for f in schema]
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(data), F.array(*map(F.lit, names)))), lambda n: F.concat(n, F.lit(": undeclared")))
    found = F.concat(F.array_compact(F.array(*errors)), F.coalesce(extra, F.array().cast("array<string>")))
    filled = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(value[n] for n in names))), lambda k, v: v.isNotNull())
    return rows.select("id", F.array_join(found, "; ").alias("errors"), filled.alias(data))


def template_names(templates: DataFrame) -> DataFrame:
    """template_id, line, what, name: the names a template needs (what: name) and what is wrong with it (error), by line from 0.

    Markers (if, for, else, endif, endfor) stand alone on lines; expressions and tags may
    stand inside other lines too.  Names bound by a loop are no needs inside it, and are
    after it; attributes, filters, tests and names of arguments are none anywhere.
    """
    kind = templates.schema["template_id"].dataType.simpleString()
    return templates.select("template_id", "text").mapInPandas(scopes.template_lines, f"template_id {kind}, line int, what string, name string")


def inspect_templates(templates: DataFrame, declared: DataFrame) -> DataFrame:
    """template_id, name, problem: variables that the schema lacks (error), declared ones that are not used (warning), and errors of structure (error, with their line)."""
    found = template_names(templates)
    wrong = found.where("what = 'error'").select("template_id", F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), "name").alias("name"), F.lit("error").alias("problem"))
    used = found.where("what = 'name'").select("template_id", "name").distinct().withColumn("u", F.lit(True))
    roots = declared.select("template_id", F.substring_index("name", ".", 1).alias("name")).distinct().withColumn("d", F.lit(True))
    both = used.join(roots, ["template_id", "name"], "full").where("u is null or d is null")
    return both.select("template_id", "name", F.when(F.col("d").isNull(), "error").otherwise("warning").alias("problem")).union(wrong)


def fill_templates(templates: DataFrame, rows: DataFrame) -> DataFrame:
    """Every template with each row's values (map) in place of {{key}}; values are not expanded again, unknown keys stay.

    The result has a row for each template and row.  Templates are sent to all tasks if
    they are small, else Spark pairs the partitions of both tables.
    """
    parts = F.split("text", r"(?=\{\{[^{}]+\}\})|(?<=\}\})")
    key = lambda p: F.regexp_extract(p, r"(?s)^\{\{([^{}]+)\}\}$", 1)
    filled = F.array_join(F.transform(parts, lambda p: F.coalesce(F.when(key(p) != "", F.col("data")[key(p)]), p)), "")
    size = templates.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    return rows.crossJoin(F.broadcast(templates) if size <= SENT else templates).select("template_id", "id", filled.alias("text"))


class Block:
    """A compiled template: text lines, if and for blocks."""

    def __init__(self, kind: str, what: str = ""):
        self.kind, self.what, self.body, self.other = kind, what, [], []


def compile_template(lines: list[str]) -> list:
    """Lines to blocks; a tag stands alone on its line: if [not] name, else, endif, for x in name, endfor."""
    root = Block("root")
    stack, into = [root], [root.body]
    for line in lines:
        tag = re.fullmatch(r"\s*" + TAG + r"\s*", line)
        if not tag:
            into[-1].append(line)
            continue
        word, _, rest = tag[1].partition(" ")
        if word in ("if", "for"):
            block = Block(word, rest)
            into[-1].append(block)
            stack.append(block)
            into.append(block.body)
        elif word == "else" and stack[-1].kind == "if":
            into[-1] = stack[-1].other
        elif word in ("endif", "endfor") and stack[-1].kind == word[3:]:
            stack.pop()
            into.pop()
        else:
            raise ValueError(f"{line.strip()} has no beginning")
    if len(stack) > 1:
        raise ValueError(f"{stack[-1].kind} {stack[-1].what} has no end")
    return root.body


def render_blocks(lines: list[str], rows: DataFrame) -> DataFrame:
    """id, text, error for rows of columns and arrays of structs; the template is compiled on the driver to one expression.

    A name that is neither a column nor a loop variable's field is an error here, a null
    value is an error row.
    """

    def value(name: str, scope: dict) -> Column:
        head, *rest = name.strip().split(".")
        c = scope[head] if head in scope else F.col(head) if head in rows.columns else None
        if c is None:
            raise ValueError(f"{name} is not known")
        for r in rest:
            c = c[r]
        return c

    def line(text: str, scope: dict) -> Column:
        pieces = re.split(r"\{\{\s*([\w.]+)\s*\}\}", text)
        return F.concat(*(value(p, scope).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)))

    def each(body: list, scope: dict, name: str):
        return lambda x: render(body, scope | {name: x})

    def render(body: list, scope: dict) -> Column:
        parts = [F.array().cast("array<string>")]
        for b in body:
            if isinstance(b, str):
                parts.append(F.array(line(b, scope)))
            elif b.kind == "if":
                negated, name = (True, b.what[4:]) if b.what.startswith("not ") else (False, b.what)
                true = F.coalesce(value(name, scope).cast("boolean"), F.lit(False))
                parts.append(F.when(~true if negated else true, render(b.body, scope)).otherwise(render(b.other, scope)))
            else:
                var, _, name = b.what.partition(" in ")
                parts.append(F.flatten(F.transform(value(name, scope), each(b.body, scope, var.strip()))))
        return F.concat(*parts)

    out = rows.select("id", render(compile_template(lines), {}).alias("lines"))
    bad = F.col("lines").isNull() | F.exists("lines", lambda x: x.isNull())
    return out.select("id", F.when(~bad, F.array_join("lines", "\n")).alias("text"), F.when(bad, F.lit("missing value")).alias("error"))


def number_refs(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, kind, role, label): labels numbered per kind by first place, references resolved, unknown ones marked."""
    first = tokens.where("role = 'label'").groupBy("doc_id", "kind", "label").agg(F.min("pos").alias("first"))
    number = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("first", "label"))
    prefix = F.coalesce(*(F.when(F.col("kind") == k, p) for k, p in PREFIX.items()), F.lit(""))
    named = first.select("doc_id", "kind", "label", F.concat(prefix, number).alias("shown"))
    return tokens.join(named, ["doc_id", "kind", "label"], "left").select("doc_id", "pos", "label", "role", F.coalesce("shown", F.lit("??")).alias("shown"), F.col("shown").isNull().alias("undefined"))


def refused_documents(numbered: DataFrame) -> DataFrame:
    """doc_id, labels: the documents that are not to be written, as they refer to labels that they do not have."""
    return numbered.where("undefined").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))


def build_toc(headings: DataFrame, width: int = TOC_WIDTH) -> DataFrame:
    """One text per document: for each heading (level, text, page) its text, dots and page; text, dots and page number together fill the width, with four dots at least."""
    page = F.col("page").cast("string")
    dots = F.repeat(F.lit("."), F.greatest(F.lit(4), F.lit(width) - F.length("text") - F.length(page)))
    line = F.concat(F.repeat(F.lit(TOC_INDENT), F.col("level") - 1), F.concat_ws(" ", "text", dots, page))
    rows = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("toc"))


def reference_list(refs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, line: the references of a document, numbered in order.

    A reference is a text, or a record (authors, title, year) whose parts are written
    with spaces between; neither is no reference and takes no number, while an empty text
    does.  Documents (doc_id) without any reference have one line that says so, with no pos.
    """
    said = T.strip(F.col("text"))
    if "record" in refs.columns:
        part = lambda c: F.nullif(c, F.lit(""))
        record = F.concat_ws(" ", part(F.array_join("record.authors", ", ")), part(F.col("record.title")), F.nullif(F.col("record.year"), F.lit(0)).cast("string"))
        said = F.coalesce(said, F.when(F.col("record").isNotNull(), record))
    rows = refs.withColumn("said", said).where("said is not null").withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))
    lines = rows.select("doc_id", "pos", F.format_string("[%d] %s", "n", "said").alias("line"))
    if docs is None:
        return lines
    none = docs.select("doc_id").distinct().join(lines, "doc_id", "left_anti")
    return lines.union(none.select("doc_id", F.lit(None).cast(lines.schema["pos"].dataType), F.lit(NO_REFERENCES)))


SCHEMA = [{"name": "k", "type": "integer", "required": True}, {"name": "title", "type": "string", "default": "none"}, {"name": "ratio", "type": "number"}, {"name": "ok", "type": "boolean", "required": True}]
TEMPLATES = "SELECT r_regionkey AS template_id, 'Dear {{name}}, ' || r_name || ': {{segment}} {{unknown}} {{balance}}' || CASE WHEN r_regionkey % 2 = 0 THEN ' {% for x in items %}{{x.a}} {{extra}}{% endfor %}{% if flag %}yes{% endif %}' ELSE '' END AS text FROM {region}"
DECLARED = "SELECT r_regionkey AS template_id, 'name' AS name FROM {region} UNION ALL SELECT r_regionkey, 'balance' FROM {region} UNION ALL SELECT r_regionkey, 'flag' FROM {region} UNION ALL SELECT r_regionkey, 'never' FROM {region}"
TOKENS = "SELECT l_orderkey AS doc_id, l_partkey AS pos, CASE WHEN l_suppkey % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 'ref' ELSE 'label' END AS role, 'l' || CAST(l_suppkey % 4 AS STRING) AS label FROM {lineitem}"
HEADINGS = "SELECT conv_id AS doc_id, turn AS pos, CAST(1 + turn % 3 AS INT) AS level, replace(text, chr(10), ' ') AS text, turn * 2 AS page FROM {conversations}"
REFS = "SELECT conv_id AS doc_id, turn AS pos, CASE WHEN turn = 1 THEN NULL ELSE text END AS text, CASE WHEN turn = 1 THEN role END AS who, turn AS n FROM {conversations} UNION ALL SELECT conv_id, turn + 1000, ' ', NULL, turn FROM {conversations} UNION ALL SELECT conv_id, turn + 2000, 'once more ' || text, NULL, turn FROM {conversations} UNION ALL SELECT -1 - conv_id, turn, NULL, NULL, turn FROM {conversations}"
#: A template for each customer: a loop, a variable used after it, expressions, and by number a stray or a missing end.
SCRIPTS = """SELECT c_custkey AS template_id, 'To {{ name }} of ' || c_mktsegment || chr(10) || '{% for x in orders %}' || chr(10) || '{{ x.id }} {{ a + b|round(n=2) }}' || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '{% endfor %}' || chr(10) END
  || '{{ x }}' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '{% endif %}' ELSE '{{ ''x'' ~ last }}' END AS text FROM {customer}"""
NESTED = [{"name": "k", "type": "integer"}, {"name": "o.t", "type": "string", "default": "none"}]
DATA = """SELECT event_id AS id, '{"k":' || CASE WHEN event_id % 11 = 0 THEN '"7"' ELSE CAST(event_id AS STRING) END || CASE WHEN event_id % 5 = 0 THEN ',"o":{"t":"' || event_type || '"}' WHEN event_id % 7 = 0 THEN ',"o":3' ELSE '' END
  || CASE WHEN event_id % 13 = 0 THEN ',"more":null' ELSE '' END || '}' AS data FROM {events}"""
LINES = ["Customer {{ name }}", "{% if rich %}", "rich in {{ segment }}", "{% else %}", "not rich", "{% endif %}", "{% for o in orders %}", "- {{ o.id }}: {{ o.status }}", "{% if o.open %}", "  open", "{% endif %}", "{% endfor %}", "end"]


def _braced(sql: str) -> str:
    """Template braces as Spark's formatter wants them; table names stay."""
    keep = re.sub(r"\{(region|customer|orders|events)\}", "\x01\\1\x02", sql)
    return keep.replace("{", "{{").replace("}", "}}").replace("\x01", "{").replace("\x02", "}")


def _customers(s, d):
    rows = derived(s, d, "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal > 5000 AS rich, CAST(CAST(c_acctbal AS BIGINT) AS STRING) AS balance FROM {customer}", "customer")
    return rows.withColumn("data", F.create_map(F.lit("name"), "name", F.lit("segment"), F.concat("segment", F.lit("{{name}}")), F.lit("balance"), "balance"))


def _with_orders(s, d):
    orders = derived(s, d, "SELECT o_custkey AS id, o_orderkey AS oid, o_orderstatus AS status FROM {orders}", "orders")
    per = orders.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("oid").alias("id"), "status", (F.col("status") == "O").alias("open")))).alias("orders"))
    return _customers(s, d).drop("data").join(per, "id", "left").withColumn("orders", F.coalesce("orders", F.array().cast(per.schema["orders"].dataType)))


def _props(s, d):
    rows = derived(s, d, "SELECT event_id AS id, props, value, event_type FROM {events}", "events")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1)
    pairs = [("k", F.when(F.col("id") % 11 == 0, F.concat(F.lit('"'), k, F.lit('"'))).when(F.col("id") % 7 != 0, k)), ("title", F.when(F.col("id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"')))), ("ok", F.when(F.col("id") % 13 == 0, F.lit("1")).otherwise("true")), ("more", F.when(F.col("id") % 5 == 0, F.lit("null")))]
    return rows.select("id", F.map_filter(F.map_from_arrays(F.array(*(F.lit(n) for n, _ in pairs)), F.array(*(c for _, c in pairs))), lambda k, v: v.isNotNull()).alias("data"))


def _validated(s, d):
    out = validate_rows(_props(s, d), SCHEMA)
    return out.select("id", "errors", F.coalesce(F.col("data")["title"], F.lit("")).alias("title"))


def _references(s, d):
    refs = derived(s, d, REFS, "conversations")
    record = F.when(F.col("who").isNotNull(), F.struct(F.array("who", F.lit("Petrov")).alias("authors"), F.lit("").alias("title"), (F.col("n") % 2 * 2000).cast("int").alias("year")))
    return reference_list(refs.withColumn("record", record), refs)


_TE, _TO, _HE = plain(TEMPLATES, "region"), plain(TOKENS, "lineitem"), plain(HEADINGS, "conversations")

QUERIES = {
    "validate_rows": _validated,
    "inspect_templates": lambda s, d: inspect_templates(derived(s, d, _braced(TEMPLATES), "region"), derived(s, d, DECLARED, "region")),
    "template_names": lambda s, d: template_names(derived(s, d, _braced(SCRIPTS), "customer")),
    "validate_data": lambda s, d: validate_data(derived(s, d, _braced(DATA), "events"), NESTED, False).withColumn("errors", F.array_join("errors", "; ")),
    "fill_templates": lambda s, d: fill_templates(derived(s, d, _braced(TEMPLATES), "region"), _customers(s, d)),
    "render_blocks": lambda s, d: render_blocks(LINES, _with_orders(s, d)),
    "number_refs": lambda s, d: number_refs(derived(s, d, TOKENS, "lineitem")),
    "refused_documents": lambda s, d: refused_documents(number_refs(derived(s, d, TOKENS, "lineitem"))),
    "build_toc": lambda s, d: build_toc(derived(s, d, HEADINGS, "conversations")),
    "reference_list": _references,
}
SQL = {
    "validate_rows": "SELECT event_id AS id, concat_ws('; ', CASE WHEN event_id % 7 = 0 AND event_id % 11 <> 0 THEN 'k: missing' END, CASE WHEN event_id % 11 = 0 THEN 'k: not integer' END, CASE WHEN event_id % 13 = 0 THEN 'ok: not boolean' END, CASE WHEN event_id % 5 = 0 THEN 'more: undeclared' END) AS errors, CASE WHEN event_id % 2 = 0 THEN '\"' || event_type || '\"' ELSE '\"none\"' END AS title FROM events",
    "inspect_templates": f"SELECT template_id, name, CASE WHEN d IS NULL THEN 'error' ELSE 'warning' END AS problem FROM (SELECT template_id, unnest(CASE WHEN contains(text, 'extra') THEN ['name', 'segment', 'unknown', 'balance', 'items', 'extra', 'flag'] ELSE ['name', 'segment', 'unknown', 'balance'] END) AS name, true AS u FROM ({_TE})) FULL JOIN (SELECT *, true AS d FROM ({plain(DECLARED, 'region')})) USING (template_id, name) WHERE u IS NULL OR d IS NULL",
    "template_names": """SELECT template_id, x.line, x.what, x.name FROM (SELECT c_custkey AS template_id, unnest([{line: 0, what: 'name', name: 'name'}]
      || CASE WHEN c_custkey % 5 = 0 THEN [{line: 1, what: 'error', name: 'missing endfor'}] ELSE [{line: 1, what: 'name', name: 'orders'}, {line: 2, what: 'name', name: 'a'}, {line: 2, what: 'name', name: 'b'}, {line: 4, what: 'name', name: 'x'},
        CASE WHEN c_custkey % 3 = 0 THEN {line: 5, what: 'error', name: 'unexpected endif'} ELSE {line: 5, what: 'name', name: 'last'} END] END) AS x FROM customer)""",
    "validate_data": """SELECT id, errors, CASE WHEN errors = '' THEN '{"k":' || id || ',"o":{"t":"' || CASE WHEN id % 5 = 0 THEN event_type ELSE 'none' END || '"}}' END AS data
      FROM (SELECT event_id AS id, event_type, concat_ws('; ', CASE WHEN event_id % 11 = 0 THEN 'k: not integer' END, CASE WHEN event_id % 5 <> 0 AND event_id % 7 = 0 THEN 'o.t: o is no object' END, CASE WHEN event_id % 13 = 0 THEN 'more: undeclared' END) AS errors FROM events)""",
    "fill_templates": f"SELECT template_id, c_custkey AS id, replace(replace(replace(replace(text, '{{{{name}}}}', c_name), '{{{{segment}}}}', c_mktsegment || '<N>'), '{{{{balance}}}}', c_acctbal_t), '<N>', '{{{{name}}}}') AS text FROM ({_TE}), (SELECT *, CAST(trunc(c_acctbal)::BIGINT AS VARCHAR) AS c_acctbal_t FROM customer)",
    "render_blocks": "SELECT c_custkey AS id, 'Customer ' || c_name || chr(10) || CASE WHEN c_acctbal > 5000 THEN 'rich in ' || c_mktsegment ELSE 'not rich' END || chr(10) || coalesce(o.t, '') || 'end' AS text, NULL::VARCHAR AS error FROM customer LEFT JOIN (SELECT o_custkey, string_agg('- ' || o_orderkey || ': ' || o_orderstatus || chr(10) || CASE WHEN o_orderstatus = 'O' THEN '  open' || chr(10) ELSE '' END, '' ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey",
    "number_refs": f"SELECT t.doc_id, t.pos, t.label, t.role, coalesce(n.shown, '??') AS shown, n.shown IS NULL AS undefined FROM ({_TO}) t LEFT JOIN (SELECT doc_id, kind, label, CASE kind WHEN 'figure' THEN 'Рис. ' ELSE 'Табл. ' END || row_number() OVER (PARTITION BY doc_id, kind ORDER BY f, label) AS shown FROM (SELECT doc_id, kind, label, min(pos) AS f FROM ({_TO}) WHERE role = 'label' GROUP BY ALL)) n USING (doc_id, kind, label)",
    "refused_documents": f"SELECT doc_id, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM ({_TO}) t WHERE NOT EXISTS (SELECT 1 FROM ({_TO}) x WHERE x.role = 'label' AND x.doc_id = t.doc_id AND x.kind = t.kind AND x.label = t.label) GROUP BY doc_id",
    "build_toc": f"SELECT doc_id, string_agg(repeat(' ', 4 * (level - 1)) || text || ' ' || repeat('.', greatest(4, 72 - length(text) - length(page::VARCHAR))::INT) || ' ' || page, chr(10) ORDER BY pos) AS toc FROM ({_HE}) GROUP BY doc_id",
    "reference_list": f"""WITH r AS ({plain(REFS, 'conversations')}), t AS (SELECT doc_id, pos, coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), who || ', Petrov' || CASE WHEN n % 2 = 1 THEN ' 2000' ELSE '' END) AS said FROM r)
      SELECT doc_id, pos, '[' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) || '] ' || said AS line FROM t WHERE said IS NOT NULL UNION ALL SELECT doc_id, NULL, '{NO_REFERENCES}' FROM t GROUP BY doc_id HAVING count(said) = 0""",
}
