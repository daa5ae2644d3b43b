"""Names and structure of templates, nested data and schemas: cases."""

import json

import pytest

from folioworks.functions import scopes
from folioworks.operators import templates


def told(*lines):
    return [(i, what, name) for i, what, name in scopes.line_names(list(lines))]


@pytest.mark.parametrize(
    ("expression", "names"),
    [
        ("a + b", ["a", "b"]), ("x.y|upper", ["x"]), ("a is defined and b is not none", ["a", "b"]), ("f(k=1, v=z)", ["f", "z"]), ("'t' ~ q", ["q"]), ("a if b else c", ["a", "b", "c"]),
        ("{'k': v}[w]", ["v", "w"]), ("not a", ["a"]), ("x == 1", ["x"]), ("items|join(', ')|f(sep=s)", ["items", "s"]), ("-a", ["a"]), ("a[1].b", ["a"]), ("[]", []), ("f()", ["f"]), ("имя.поле", ["имя"]),
        ("a b", None), ("(a", None), ("a)", None), ("a +", None), ("", None), ("a ? b", None), ("'open", None),
    ],
)
def test_free_names(expression, names):
    assert scopes.names_in(expression) == names


def test_loop_variables_are_bound_inside_the_loop_only():
    assert told("{% for x in xs %}", "{{ x }} {{ y }}", "{% endfor %}", "{{ x }}") == [(0, "name", "xs"), (1, "name", "y"), (3, "name", "x")]
    assert told("{% for x in x %}", "{% endfor %}") == [(0, "name", "x")]
    assert told("a {% for x in xs %}{{ x }}{{ loop.index }}{% endfor %}{{ x }}") == [(0, "name", "xs"), (0, "name", "x")]
    assert told("{{ toc() }} {{ id('a') }}") == []


def test_errors_of_structure():
    assert told("{% endif %}", "{{ a }}") == [(0, "error", "unexpected endif"), (1, "name", "a")]
    assert told("{{ a }}", "{% for x in xs %}", "{{ b }}") == [(0, "name", "a"), (1, "error", "missing endfor")]
    assert told("{% if a %}", "{% for x in xs %}", "{{ b }}", "{% endif %}", "{% endfor %}") == [(0, "name", "a"), (1, "error", "missing endfor"), (4, "error", "unexpected endfor")]
    assert told("{% else %}") == [(0, "error", "unexpected else")]
    assert told("{% if a %}", "{{ b }}", "{% else %}", "{{ c }}", "{% endif %}") == [(0, "name", "a"), (1, "name", "b"), (3, "name", "c")]
    assert told("{% for xs %}", "{{ a }}", "{% endfor %}", "{{ b }}") == [(0, "error", "for xs cannot be read"), (3, "name", "b")]
    assert told("{{ malformed ", "{% if enabled %}", "x") == [(0, "error", "{{ does not end"), (1, "error", "missing endif")]
    assert told("a {% if b %} c") == [(0, "name", "b"), (0, "error", "missing endif")]


def test_inspection_with_a_schema(spark):
    texts = [(1, "{% if enabled %}\n{% for item in items %}\n{{ item.name }} / {{ suffix }}\n{% endfor %}\n{% endif %}"), (2, None), (3, "{% if enabled %}\nx")]
    declared = [(1, "enabled"), (1, "items"), (1, "suffix.long"), (1, "unused"), (2, "title"), (3, "enabled")]
    got = templates.inspect_templates(spark.createDataFrame(texts, "template_id int, text string"), spark.createDataFrame(declared, "template_id int, name string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "unused", "warning"), (2, "title", "warning"), (3, "enabled", "warning"), (3, "line 0: missing endif", "error")]


def validated(spark, schema, allow_extra, *rows, **how):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, data string")
    return [(list(r["errors"]), r["data"] and json.loads(r["data"])) for r in templates.validate_data(df, schema, allow_extra, **how).orderBy("id").collect()]


def test_nested_defaults_are_filled_in(spark):
    schema = [{"name": "title", "type": "string"}, {"name": "options.locale", "type": "string", "required": False, "default": "ru-RU"}]
    assert validated(spark, schema, False, '{"title": "Report"}', '{"title": "é\\"", "options": {"more": [1, {"q": null}]}}') == [
        ([], {"title": "Report", "options": {"locale": "ru-RU"}}),
        ([], {"title": 'é"', "options": {"locale": "ru-RU", "more": [1, {"q": None}]}}),
    ]
    deep = [{"name": "a.b.c", "type": "number", "default": 1.5}, {"name": "o", "type": "object", "default": {"k": [1]}}, {"name": "o.z", "type": "array", "default": []}]
    assert validated(spark, deep, True, "{}", '{"a": {"b": {"d": 2}}, "o": {"z": [3]}, "x": 1}') == [
        ([], {"a": {"b": {"c": 1.5}}, "o": {"k": [1], "z": []}}),
        ([], {"a": {"b": {"c": 1.5, "d": 2}}, "o": {"z": [3]}, "x": 1}),
    ]


def test_all_errors_are_told_together(spark):
    schema = [{"name": "title", "type": "string"}, {"name": "count", "type": "integer"}]
    assert validated(spark, schema, False, '{"count": "many", "unexpected": true}') == [(["title: missing", "count: not integer", "unexpected: undeclared"], None)]


def test_defaults_do_not_replace_what_is_no_object(spark):
    schema = [{"name": "a.b.c", "type": "any", "default": 1}]
    assert validated(spark, schema, True, '{"a": 5}', '{"a": {"b": "x"}}', '{"a": null}', '{"a": {"b": {"c": null}}}') == [
        (["a.b.c: a is no object"], None), (["a.b.c: a.b is no object"], None), (["a.b.c: a is no object"], None), ([], {"a": {"b": {"c": None}}}),
    ]


def test_kinds_of_values(spark):
    values = {"string": '"x"', "integer": "3", "number": "2.5", "boolean": "true", "array": "[1]", "object": '{"a":1}', "null": "null", "big": "12345678901234567890123"}
    fits = {
        "any": set(values), "string": {"string"}, "integer": {"integer", "big"}, "number": {"integer", "number", "big"}, "boolean": {"boolean"},
        "array": {"array"}, "object": {"object"}, "image": {"string", "object"}, "formula": {"string", "object"},
    }
    schema = [{"name": k, "type": k, "required": False} for k in fits]
    rows = ["{" + ", ".join(f'"{k}": {v}' for k in fits) + "}" for v in values.values()]
    for of, (errors, _) in zip(values, validated(spark, schema, True, *rows), strict=True):
        assert {k for k in fits if f"{k}: not {k}" not in errors} == {k for k in fits if of in fits[k]}, of


def test_data_that_are_no_objects(spark):
    schema = [{"name": "a", "type": "any"}]
    got = validated(spark, schema, True, "[1]", "nope", None, '{"a": 1, "a": 2}', '{"a": "' + "x" * 50 + '"}', '{"a": 1}', most_bytes=40)
    assert [e for e, _ in got] == [["the data are no object"]] * 4 + [["the data are too large"], []]
    assert validated(spark, [], False, "{}", '{"a": 1}') == [([], {}), (["a: undeclared"], None)]
    with pytest.raises(ValueError, match="twice"):
        templates.schema_tree([{"name": "a.b", "type": "any"}, {"name": "a.b", "type": "any"}])
