"""What a template needs and what is wrong with it: a fold over its tokens with the names that are bound at each place."""

import re
from collections.abc import Iterator

import pandas as pd

#: A line that is one marker; names that templates always have.
MARKER = re.compile(r"\s*\{%\s*(if|for|else|endif|endfor)\b(.*?)%\}\s*", re.S)
ALWAYS = {"toc", "bibliography", "id", "ref"}
#: Words of expressions that are no names.
WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}
_TOKEN = re.compile(r"""\s+|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<sign>==|!=|<=|>=|//|\*\*|[-+*/%~<>=.,:|()\[\]{}])""")
_INLINE = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}|\{#.*?#\}|(\{\{|\{%|\{#)", re.S)
_FOR = re.compile(r"([^\W\d]\w*)\s+in\s+(.+)", re.S)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def names_in(expression: str) -> list[str] | None:
    """The free names of an expression, in order; None if it cannot be read.

    Attributes, filters, tests, names of arguments, words of the language and texts are
    no names; brackets must close, and an operand must follow an operator.
    """
    at, found, before, opened, operand = 0, [], "", [], False
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        word = m[0]
        if kind == "name" and word not in WORDS:
            named = re.match(r"\s*=(?!=)", text[at:]) and opened and opened[-1] == "("
            if before not in (".", "|", "is", "is not") and not named:
                if operand:
                    return None
                found.append(word)
            operand = True
        elif kind in ("text", "number") or (kind == "name" and word in ("true", "false", "none", "True", "False", "None")):
            if operand and not (kind == "text" and before == "text"):
                return None
            operand = True
        elif kind == "name":
            if word in ("and", "or", "is", "else") and not operand or before == "|":
                return None
            operand = False
        elif word in "([{":
            opened.append(word)
            operand = False
        elif word in _CLOSES:
            if not opened or opened.pop() != _CLOSES[word] or (not operand and before not in ("(", "[", "{", ",")):
                return None
            operand = True
        else:
            if not operand and word not in ("-", "+"):
                return None
            operand = False
        before = f"{before} {word}" if word == "not" and before == "is" else word if kind in ("name", "sign") else kind
    return found if operand and not opened else None


def text_names(text: str, bound: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(what, name) of a text with expressions and tags inside: names that are not bound, and errors; its own tags must close within it."""
    stack: list[tuple[str, frozenset[str]]] = []
    for m in _INLINE.finditer(text):
        if m[3]:
            yield "error", f"{m[3]} does not end"
            return
        if m[1] is not None:
            yield from _free(m[1], bound)
            continue
        if m[2] is None:
            continue
        word, _, rest = m[2].partition(" ")
        if word in ("if", "for"):
            loop = _FOR.fullmatch(rest.strip()) if word == "for" else None
            if word == "for" and not loop:
                yield "error", f"for {rest.strip()} cannot be read"
                return
            yield from _free(loop[2] if loop else rest, bound)
            stack.append((word, bound))
            bound = bound | {loop[1], "loop"} if loop else bound
        elif word == "elif" and stack and stack[-1][0] == "if":
            yield from _free(rest, bound)
        elif word == "else" and stack:
            bound = stack[-1][1]
        elif word == "set" and "=" in rest:
            name, _, value = rest.partition("=")
            yield from _free(value, bound)
            bound = bound | {name.strip()}
        elif word in ("endif", "endfor") and stack and stack[-1][0] == word[3:]:
            bound = stack.pop()[1]
        else:
            yield "error", f"unexpected {word}"
            return
    if stack:
        yield "error", f"missing end{stack[-1][0]}"


def _free(expression: str, bound: frozenset[str]) -> Iterator[tuple[str, str]]:
    names = names_in(expression)
    if names is None:
        yield "error", f"{expression.strip()} cannot be read"
    for n in dict.fromkeys(names or ()):
        if n not in bound and n not in ALWAYS:
            yield "name", n


def _pairs(marks: list[tuple[str, str] | None]) -> tuple[dict[int, int], dict[int, int]]:
    """Of each opening line its closing one of the same kind, and of each `if` its last `else`."""
    open_, ends, others = {"if": [], "for": []}, {}, {}
    for i, m in enumerate(marks):
        word = m[0] if m else ""
        if word in open_:
            open_[word].append(i)
        elif word == "else" and open_["if"]:
            others[open_["if"][-1]] = i
        elif word[:3] == "end" and open_[word[3:]]:
            ends[open_[word[3:]].pop()] = i
    return ends, others


def line_names(lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """(line, what, name) of a template whose markers stand alone on lines; lines count from 0.

    A loop's variable is bound between its `for` and `endfor` only.  Where an end is
    missing, the rest of the enclosing block is not looked at.
    """
    marks = [(m[1], m[2].strip()) if (m := MARKER.fullmatch(x)) else None for x in lines]
    ends, others = _pairs(marks)
    work = [(0, len(lines), frozenset())]
    while work:
        i, stop, bound = work.pop()
        if i >= stop:
            continue
        rest = (i + 1, stop, bound)
        if marks[i] is None:
            yield from ((i, *x) for x in text_names(lines[i], bound))
        elif marks[i][0] not in ("if", "for"):
            yield i, "error", f"unexpected {marks[i][0]}"
        elif ends.get(i, stop) >= stop:
            yield i, "error", f"missing end{marks[i][0]}"
            continue
        else:
            word, expression = marks[i]
            rest, parts = (ends[i] + 1, stop, bound), [(i + 1, ends[i], bound)]
            if word == "for":
                loop = _FOR.fullmatch(expression)
                parts = [(i + 1, ends[i], bound | {loop[1]})] if loop else []
                found = _free(loop[2], bound) if loop else iter([("error", f"for {expression} cannot be read")])
            else:
                found = _free(expression, bound)
                if i < others.get(i, -1) < ends[i]:
                    parts = [(i + 1, others[i], bound), (others[i] + 1, ends[i], bound)]
            yield from ((i, *x) for x in found)
            work += [rest, *reversed(parts)]
            continue
        work.append(rest)


def template_lines(batches):
    """mapInPandas: template_id, text -> template_id, line, what (name or error), name."""
    for pdf in batches:
        rows = [(t, *x) for t, text in zip(pdf["template_id"], pdf["text"], strict=True) for x in line_names((text or "").split("\n"))]
        yield pd.DataFrame(rows, columns=["template_id", "line", "what", "name"])
