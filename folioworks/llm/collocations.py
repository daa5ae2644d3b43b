"""Collocations: phrases of two to five words whose weakest cut still is far from chance.

Counts come from padded longest windows: shifted (lead) columns give each word with the
four that follow it in its piece, padded where the piece ends, only these windows are
counted, and a ROLLUP sums them to their shorter prefixes, which are the counts of all
shorter phrases.

Three passes before it keep the windows few.  A phrase that occurs often enough consists
of words, pairs and triples of words that do, so pieces are cut at all others: words are
counted first, then pairs of words that passed, then triples of such pairs, and all tests
are bit sets of bounded size in which a false hit only leaves a window that the final
count drops.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bits import Bits, bit_set, mix
from .common import give_back, join_hot, staged, table

#: Words of the longest phrase, least occurrences of a phrase, phrases reported for a language.
ORDER, LEAST, TOP = 5, 100, 2000
#: A phrase goes if a longer one around it has at least so many hundredths of its occurrences.
INSIDE = 100
#: Bytes of text split at once, bytes and distinct words worked on together.
SLICE, CHUNK, MOST_WORDS = 1 << 20, 16 << 20, 400_000
#: Parts that the first phrases of a language are picked in before they are ranked.
SALT = 32
#: A-Z in lower case, tabs as spaces, and what ends a piece (``.,;:!?`` and the line breaks from 10 to 13) as one mark.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_END, _NONE = 0, 1


class Coder(dict):
    """Numbers of words in order of their first coming; 0 is the end of a piece, 1 the empty word."""

    def __init__(self):
        self.words: list[bytes] = []
        for w in (b"\n", b""):
            self[w]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def strings(self) -> pa.Array:
        return pa.array(self.words, pa.binary()).cast(pa.string())

    def hashes(self, lang: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        salt = np.uint64(xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        return mix(np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, len(self.words)) ^ salt)


def coded(texts: list[bytes], coder: Coder) -> np.ndarray:
    """The words of the texts as numbers, an end after each piece; whole texts, split a slice at a time."""
    out, joined, size = [], [], 0
    for i, t in enumerate(texts):
        joined.append(t)
        size += len(t)
        if size < SLICE and i + 1 < len(texts):
            continue
        buf, at = b"\n".join(joined).translate(_BYTES).replace(b"\n", b" \n ") + b" \n", 0
        while at < len(buf):
            end = buf.find(b" ", at + SLICE)
            found = buf[at : end if end >= 0 else len(buf)].split(b" ")
            out.append(np.fromiter(map(coder.__getitem__, found), np.int32, len(found)))
            at = end if end >= 0 else len(buf)
        joined, size = [], 0
    codes = np.concatenate(out) if out else np.empty(0, np.int32)
    return codes[codes != _NONE]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of about CHUNK bytes from batches of lang and text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK:
                yield lang, held.pop(lang)
                size[lang] = 0
    for lang in list(held):
        yield lang, held.pop(lang)


def _frame(lang: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *columns.values()], ["lang", *columns])


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n: how often each word occurs in the texts (lang, text) of a language."""

    def count(batches):
        held: dict[str, tuple[Coder, np.ndarray]] = {}

        def told(lang):
            coder, n = held.pop(lang)
            some = np.flatnonzero(n)
            for i in range(0, len(some), 50_000):
                part = pa.array(some[i : i + 50_000])
                yield _frame(lang, {"word": coder.strings().take(part), "n": pa.array(n).take(part)})

        for lang, part in chunks(batches):
            coder, n = held.get(lang) or (Coder(), np.zeros(0, np.int64))
            codes = coded(part, coder)
            found = np.bincount(codes, minlength=len(coder.words))
            found[: len(n)] += n
            found[_END] = 0
            held[lang] = coder, found
            if sum(len(c.words) for c, _ in held.values()) > MOST_WORDS:
                for lang in list(held):
                    yield from told(lang)
        for lang in list(held):
            yield from told(lang)
        give_back()

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _word_hashes(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            by: dict[str, Coder] = {}
            for lang, word in zip(batch["lang"].to_pylist(), batch["word"].cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(lang, Coder())[word]
            for lang, coder in by.items():
                yield pa.RecordBatch.from_arrays([pa.array(coder.hashes(lang)[2:].view(np.int64))], ["h"])

    return words.select("lang", "word").mapInArrow(run, "h long")


def known_runs(codes: np.ndarray, coder: Coder, lang: str, sets: list[Bits]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, at, hashes): whether the run of len(sets) words that begins at each place is known, and the places and hashes of runs of one word more.

    sets hold the hashes of known words, of known pairs, and so on; a run is asked for
    only if both runs of one word less inside it are known.
    """
    h = coder.hashes(lang)
    word = sets[0].has(h)
    word[:2] = False
    known, h = word[codes], h[codes]
    grams = h
    for k in range(1, len(sets) + 1):
        at = np.flatnonzero(known[:-1] & known[1:])
        longer = mix(grams[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
        if k == len(sets):
            return known, at, longer
        known, grams = np.zeros(len(codes), bool), np.zeros(len(codes), np.uint64)
        grams[at] = longer
        known[at] = sets[k].has(longer)
    raise ValueError("no sets")


def run_counts(texts: DataFrame, sets: list[Bits]) -> DataFrame:
    """h, n: occurrences of runs of one word more than the sets tell of, by the run's hash."""
    shared = texts.sparkSession.sparkContext.broadcast(sets)

    def count(batches):
        for lang, part in chunks(batches):
            coder = Coder()
            _, _, h = known_runs(coded(part, coder), coder, lang, shared.value)
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
        give_back()

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def lead_windows(texts: DataFrame, sets: list[Bits]) -> DataFrame:
    """lang, w1 to w5, n: the longest window that begins at each known pair, padded by empty words where the piece or the known runs end; equal ones of a chunk are counted together.

    sets: words, pairs and triples.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sets)
    names = [f"w{i + 1}" for i in range(ORDER)]

    def count(batches):
        for lang, part in chunks(batches):
            coder = Coder()
            codes = coded(part, coder)
            pairs, _, _ = known_runs(codes, coder, lang, shared.value[:2])
            triples, _, _ = known_runs(codes, coder, lang, shared.value)
            at = np.flatnonzero(pairs)
            if not len(at):
                continue
            codes, triples = np.concatenate([codes, np.full(ORDER, _NONE, np.int32)]), np.concatenate([triples, np.zeros(ORDER, bool)])
            columns, inside = [codes[at], codes[at + 1]], np.ones(len(at), bool)
            key = codes[at].astype(np.int64) * len(coder.words) + codes[at + 1]
            for i in range(2, ORDER):
                inside = inside & triples[at + i - 2]
                columns.append(np.where(inside, codes[at + i], _NONE))
                key = np.unique(key, return_inverse=True)[1] * len(coder.words) + columns[-1]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            strings = coder.strings()
            yield _frame(lang, {w: strings.take(pa.array(c[first])) for w, c in zip(names, columns, strict=True)} | {"n": pa.array(n)})
        give_back()

    return texts.mapInArrow(count, "lang string, " + ", ".join(f"{w} string" for w in names) + ", n long").groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words (array), a: phrases of two words and more that occur `least` times, as sums of windows by prefix."""
    rolled = windows.sparkSession.sql(
        "SELECT lang, w1, w2, w3, w4, w5, sum(n) AS a, grouping_id() AS g FROM {windows} GROUP BY lang, w1, w2, ROLLUP (w3, w4, w5) HAVING sum(n) >= {least}",
        windows=windows, least=least,
    )
    whole = F.expr("CASE g WHEN 0 THEN w5 WHEN 1 THEN w4 WHEN 3 THEN w3 ELSE w2 END <> ''")  # else a shorter phrase, padded
    words = F.array_compact(F.array("w1", "w2", "w3", "w4", "w5"))
    return rolled.where(whole).select("lang", words.alias("words"), "a")


def with_parts(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """cuts (lang, phrase, a, k, left, right) with l, r and n: the counts (lang, part, n) of both parts, and of the language, whose part is the empty word.

    A cut asks for three counts, a row each; parts that many cuts ask for are told apart
    and sent to all tasks.
    """
    asked = F.array(*(F.struct(F.lit(s).alias("side"), p.alias("part")) for s, p in (("l", F.col("left")), ("r", F.col("right")), ("n", F.lit("")))))
    asked = staged(cuts.select("lang", "phrase", "a", "k", F.inline(asked)), "asked")
    keyed = staged(counts.join(asked.groupBy("lang", "part").agg(F.count("*").alias("count")), ["lang", "part"]), "keyed")
    told = join_hot(asked, keyed, ["lang", "part"], asked.count())
    return told.groupBy("lang", "phrase", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in "lrn"))


def find_collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    A-Z are lower-cased; ``.,;:!?`` and line breaks end a piece; words are what spaces and
    tabs leave.  a is the phrase's occurrences in its language (at least `least`), n the
    language's words; a cut after the first words gives l and r, the occurrences of both
    parts, and floor(1000 a n / (l r)), in whole numbers of 38 digits; the cut of the
    least score counts, of equal ones the first.  A phrase goes if a longer one that
    occurs often enough contains it and has `inside` hundredths of its occurrences.
    Order: score, then a, descending, then phrase by its bytes.  A null text is empty, a
    null lang `und`; equal rows count as often as they come; an empty table or one
    without such phrases gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = staged(word_counts(texts), "words")
    often = words.where(F.col("n") >= least)
    sets = [bit_set(_word_hashes(often))]
    for run in ("pairs", "triples"):
        sets.append(bit_set(staged(run_counts(texts, sets).where(F.col("n") >= least), run)))
    phrases = staged(phrase_counts(lead_windows(texts, sets), least).withColumn("phrase", F.array_join("words", " ")), "phrases")

    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = often.select("lang", F.col("word").alias("part"), "n").union(phrases.select("lang", "phrase", "a")).union(totals.select("lang", F.lit(""), "n"))
    cuts = with_parts(cuts, counts)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumns({"above": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "below": wide("l") * wide("r")})
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r", "n")).alias("cut"))

    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    around = phrases.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.*").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = kept.withColumn("nth", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))  # SALT times top rows at most
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return find_collocations(table(spark, sf_dir, "documents"))


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase, {k} AS k FROM pieces WHERE len(w) >= {k}" for k in range(1, ORDER + 1))
    part = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    inner = " UNION ALL ".join(f"SELECT lang, {part(i, i + n - 1)} AS phrase, a FROM c WHERE len(w) > {n} AND len(w) >= {i + n - 1}" for n in range(2, ORDER) for i in range(1, ORDER - n + 2))
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS cut FROM c),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * cuts.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = {part(1, 'cut')} JOIN f y ON y.lang = cuts.lang AND y.phrase = {part('cut + 1', 'len(w)')} JOIN n ON n.lang = cuts.lang),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored) WHERE nth = 1),
around AS (SELECT lang, phrase, max(a) AS around FROM ({inner}) GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < {INSIDE} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {TOP}
"""


#: The same from all phrases of one to five words, counted one by one.
OP11_SQL = _sql()
