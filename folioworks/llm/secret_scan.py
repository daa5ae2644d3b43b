"""Secret scans with DataFrame functions only: fixed patterns, and windows of high entropy.

Three fixed patterns give the base spans.  Beside them, runs of hexadecimal or of base64
characters are looked at through a sliding window: each step adds the coming character's
count and takes off the leaving one's, and the Shannon entropy follows from the changed
counts alone.  Windows above their class's threshold are joined into spans; what an allow
list knows to be harmless is left out.

The counts of a window stand in seven whole numbers, five bits for each character from
``+`` to ``z``, so a step changes two of 84 counters.  Entropies are compared as whole numbers (c log2 c in units
of 2^-32), so every engine gets the same spans.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The base patterns, in the order in which kinds are listed. Runs shorter than what is asked for are skipped
#: whole, so a least length inside the pattern gives the same matches for access and hex; assign is filtered afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6


@dataclass(frozen=True)
class EntropyClass:
    """kind of the spans; pattern of the runs; least entropy of a window in bits a character; what a window must hold besides."""

    kind: str
    pattern: str
    bits: float
    must: tuple[str, ...] = ()


#: Characters in a window.
WINDOW = 20
CLASSES = (
    EntropyClass("entropy_hex", rf"(?<![0-9A-Za-z])[0-9a-fA-F]{{{WINDOW},}}(?![0-9A-Za-z])", 3.0, ("[0-9]", "[A-Fa-f]")),
    EntropyClass("entropy_base64", rf"[0-9A-Za-z+/_-]{{{WINDOW},}}", 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
)
#: Runs that contain one of these are harmless: sums of packages in lock files, identifiers of the 8-4-4-4-12 form,
#: alphabets and digits in a row, placeholders, and paths of several short words.
ALLOW = (
    r"(?i)sha(256|384|512)-",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)example|placeholder|changeme|your[_-]",
    r"(/[A-Za-z]{1,15}){3,}",
)
#: Units of c log2 c, steps of a running sum that are done at once, window starts of a part of a run.
UNIT, STEP, PART = 1 << 32, 64, 256


def weights(window: int = WINDOW) -> list[int]:
    """c log2 c of the counts 0 to window, in whole units."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def most_weight(bits: float, window: int = WINDOW) -> int:
    """A window's entropy is log2(window) - weight / window; it is at least `bits` where the weight is at most this."""
    return math.floor((math.log2(window) - bits) * window * UNIT)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it stands in the result."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def running_ends(lengths: Column) -> Column:
    """Running sums of an array: STEP of them at a time, so that no long array is copied for each of its elements."""
    zero = F.lit(0).cast("bigint")
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)

    def run(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda acc, x: acc + x))
        before = F.aggregate(totals, F.array(zero), add)
        return F.flatten(F.zip_with(F.slice(before, 1, F.size(parts)), parts, lambda b, p: F.slice(F.aggregate(p, F.array(b), add), 2, F.lit(STEP))))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(xs, i + 1, F.lit(STEP)))
    return let(let(lengths, cut), run)


def matched(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost and not overlapping: an array of (start, found), in code points.

    What stands between matches is what the text splits into at them, so the starts are
    running sums of both lengths.
    """

    def placed(found: Column) -> Column:
        both = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(running_ends(both), found, lambda e, m: F.struct((e - F.length(m)).alias("start"), m.alias("found")))

    none = F.array().cast("array<struct<start:bigint,found:string>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)).otherwise(none)


def _change(counts: Column, code: Column, by: int) -> Column:
    """counts, five bits a character and twelve characters a number, with that of a character changed."""
    at, shift = F.floor(code / 12).cast("int"), (code % 12) * 5
    return F.transform(counts, lambda c, i: F.when(i == at, c + F.call_function("shiftleft", F.lit(by).cast("bigint"), shift)).otherwise(c))


def _count(counts: Column, code: Column) -> Column:
    return F.call_function("shiftright", F.get(counts, F.floor(code / 12).cast("int")), (code % 12) * 5).bitwiseAND(31).cast("int")


def high_windows(run: Column, most: int, window: int = WINDOW) -> Column:
    """Starts (from 0, ascending) of the windows of a run of base64 characters whose weight is at most `most`.

    The run is folded in parts of PART windows.  The state holds the window's counts,
    its weight and the starts found; a step takes the leaving character's count off,
    then adds the coming one's.
    """
    table_ = F.array(*(F.lit(w).cast("bigint") for w in weights(window)))

    def gone(acc: Column, leaving: Column) -> Column:
        n = _count(acc["counts"], leaving)
        less = F.get(table_, n) - F.get(table_, n - 1)
        taken = F.struct(_change(acc["counts"], leaving, -1).alias("counts"), (acc["weight"] - less).alias("weight"))
        return F.when(leaving.isNull(), F.struct(acc["counts"].alias("counts"), acc["weight"].alias("weight"))).otherwise(taken)

    def come(acc: Column, left: Column, move: Column, start: Column) -> Column:
        n = _count(left["counts"], move["coming"])
        weight = left["weight"] + F.get(table_, n + 1) - F.get(table_, n)
        found = (move["nth"] >= window - 1) & (weight <= most)
        starts = F.when(found, F.array_append(acc["starts"], start + move["nth"] - (window - 1))).otherwise(acc["starts"])
        return F.struct(_change(left["counts"], move["coming"], 1).alias("counts"), weight.alias("weight"), starts.alias("starts"))

    def part(start: Column) -> Column:
        begin = F.struct(F.array_repeat(F.lit(0).cast("bigint"), 7).alias("counts"), F.lit(0).cast("bigint").alias("weight"), F.array().cast("array<int>").alias("starts"))
        chars = F.transform(F.split(F.substring(run, start + 1, F.lit(PART + window - 1)), ""), lambda c: F.ascii(c) - 43)
        moves = let(chars, lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("coming"), F.get(cs, i - window).alias("leaving"), i.alias("nth"))))
        return F.aggregate(moves, begin, lambda acc, m: let(gone(acc, m["leaving"]), lambda left: come(acc, left, m, start)), lambda acc: acc["starts"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(run) - window, F.lit(PART)), part))


def joined_spans(starts: Column, window: int = WINDOW) -> Column:
    """(start, end) of the unions of windows that overlap or touch, from ascending starts."""

    def cut(xs: Column) -> Column:
        first = F.filter(xs, lambda x, i: (i == 0) | (x - F.get(xs, i - 1) > window))
        last = F.filter(xs, lambda x, i: (i == F.size(xs) - 1) | (F.get(xs, i + 1) - x > window))
        return F.zip_with(first, last, lambda a, b: F.struct(a.cast("bigint").alias("start"), (b + window).cast("bigint").alias("end")))

    return let(starts, cut)


def entropy_spans(text: Column, of: EntropyClass, allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> Column:
    """An array of (start, end) of spans of high entropy in the runs of a class that no allowed pattern touches."""

    def wanted(m: Column) -> Column:
        ok = F.lit(True)
        for p in of.must:
            ok = ok & m["found"].rlike(p)
        for p in allow:
            ok = ok & ~m["found"].rlike(p)
        return ok

    runs = F.filter(matched(text, of.pattern), wanted)
    spans = F.transform(runs, lambda m: F.transform(joined_spans(high_windows(m["found"], most_weight(of.bits, window), window), window), lambda s: F.struct((s["start"] + m["start"]).alias("start"), (s["end"] + m["start"]).alias("end"))))
    return F.flatten(spans)


def _named(spans: Column, end_of: Callable[[Column], Column], nth: int, kind: str) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(nth).alias("nth"), end_of(m).cast("bigint").alias("end"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, text_col: str = "text") -> DataFrame:
    """docs with one more column, secrets: an array of (start, end, kind, nth) in order of start and kind.

    Kinds 0 to 2 (nth) are assign, access and hex; then come the classes of entropy, whose
    spans are added whatever base spans they overlap.  Starts and ends are code points,
    ends exclusive.  A null or empty text has none; equal texts, wherever they stand, have
    the same; nothing is asked of other columns, and rows are neither joined nor shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    end = lambda m: m["start"] + F.length(m["found"])
    value = lambda m: F.regexp_extract(m["found"], ASSIGN, 1)
    found = [("assign", F.filter(matched(text, ASSIGN), lambda m: F.length(value(m)) >= ASSIGN_LEAST), end), ("access", matched(text, ACCESS), end), ("hex", matched(text, HEX), end)]
    found += [(c.kind, entropy_spans(text, c, allow), lambda s: s["end"]) for c in classes]
    named = [_named(spans, end_of, n, kind) for n, (kind, spans, end_of) in enumerate(found)]
    return docs.withColumn("secrets", F.array_sort(F.concat(*named)))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda i: F.size(F.filter("secrets", lambda s: s["nth"] == i)).cast("long")
    base = F.filter("secrets", lambda s: s["nth"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"))


def _sql() -> str:
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join(letters(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"""(?:{keys})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    hexes, base64 = CLASSES
    found = [
        ("assign", assign, f"length(regexp_extract(f, '{assign}', 1)) >= {ASSIGN_LEAST}"),
        ("access", "AKIA[A-Z0-9]+", "length(f) >= 20"),
        ("hex", "[0-9a-f]+", "length(f) >= 24"),
        (hexes.kind, "[0-9A-Za-z]+", f"regexp_full_match(f, '[0-9A-Fa-f]{{{WINDOW},}}')"),
        (base64.kind, "[0-9A-Za-z+/_-]+", f"length(f) >= {WINDOW}"),
    ]
    allowed = "".join(f" AND NOT regexp_matches(f, '{p}')" for p in ALLOW)
    parts = []
    for n, (kind, pattern, keep) in enumerate(found):
        if n > 2:
            keep += "".join(f" AND regexp_matches(f, '{p}')" for p in CLASSES[n - 3].must) + allowed
        split = f"SELECT rid, regexp_extract_all(t, '{pattern}') AS fs, string_split_regex(t, '{pattern}') AS gs FROM d"
        at = f"SELECT rid, unnest(fs) AS f, unnest(list_transform(gs[1:len(fs)], lambda g: length(g))) AS g, generate_subscripts(fs, 1) AS i FROM ({split}) WHERE len(fs) > 0"
        placed = f"SELECT rid, f, sum(length(f) + g) OVER (PARTITION BY rid ORDER BY i)::BIGINT - length(f) AS s FROM ({at})"
        if n < 3:
            parts.append(f"SELECT rid, s, {n} AS nth, s + length(f) AS e, '{kind}' AS kind FROM ({placed}) WHERE {keep}")
            continue
        weight = f"list_sum(list_transform(map_values(list_aggregate(string_split(substr(f, (i + 1)::INT, {WINDOW}), ''), 'histogram')), lambda c: ({weights()}::BIGINT[])[(c + 1)::INT]))"
        windows = f"SELECT rid, s, i FROM (SELECT rid, s, f, unnest(range(length(f) - {WINDOW - 1})) AS i FROM ({placed}) WHERE {keep}) WHERE {weight} <= {most_weight(CLASSES[n - 3].bits)}"
        marked = f"SELECT *, (i - coalesce(lag(i) OVER (PARTITION BY rid, s ORDER BY i), -99999) > {WINDOW})::INT AS new FROM ({windows})"
        islands = f"SELECT *, sum(new) OVER (PARTITION BY rid, s ORDER BY i) AS g FROM ({marked})"
        parts.append(f"SELECT rid, s + min(i), {n}, s + max(i) + {WINDOW}, '{kind}' FROM ({islands}) GROUP BY rid, s, g")
    spans = " UNION ALL ".join(parts)
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED ({spans}),
told AS (SELECT rid, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex, {told} FILTER (nth < 3) AS base, {told} AS every FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""


#: The same from plain matches; every window's entropy is counted anew.
OP13_SQL = _sql()
