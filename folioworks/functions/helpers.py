"""Vectorised helpers for what Spark's functions cannot say; each works on a column of Arrow batches."""

import unicodedata
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def composed(text: pa.Array, at_once: int = 128) -> pa.Array:
    """Compatibility composition of Unicode text; of a batch only a few texts are Python's own at a time."""
    parts = [pa.array([t and unicodedata.normalize("NFKC", t) for t in text.slice(at, at_once).to_pylist()], pa.string()) for at in range(0, len(text), at_once)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return composed(text)


@F.arrow_udf(StringType())
def casefold(text: pa.Array) -> pa.Array:
    """Text without differences of case."""
    return text if text.null_count == len(text) else pa.array([t and t.casefold() for t in text.to_pylist()], pa.string())


@F.pandas_udf(StringType())
def decode_1251(content: pd.Series) -> pd.Series:
    """Windows-1251 bytes as text."""
    return content.map(lambda b: bytes(b).decode("cp1251", "replace"), na_action="ignore")


@F.pandas_udf(StringType())
def decode_dropping(content: pd.Series) -> pd.Series:
    """UTF-8 bytes as text without the bytes that are not valid."""
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")


class Names:
    """Names beside which words are put: whether their similarity (SequenceMatcher's ratio, the name first) is at least `least`.

    Twice the characters in common, over both lengths, bounds the similarity: each repeat
    of a character that some name has is a bit, so they are counted for many words and
    names at once.  A name of up to 64 characters is also a word of bits for each
    character.  With these the longest common subsequence of the pairs that are left is
    found a character at a time; it bounds the similarity, too.  The matching blocks of
    what is left then are found by shifts of the same bits.  Longer names, and words of
    which the matcher would take no notice of common characters, go to the matcher itself.
    """

    PLACES, COMMON = 64, 200  # bits, length from which the matcher drops common characters
    CELLS, WORDS, PAIRED = 1 << 19, 1 << 13, 1 << 19  # at once: words by names, words, characters of the words of similar pairs
    BAGS = 4  # words of bits for repeats; names with more of them (of large alphabets) are not compared by characters in common

    def __init__(self, names: list[str], least: float):
        self.names, self.least = names, least
        sizes = np.array([len(n) for n in names], np.int64)
        self.long, self.short = np.flatnonzero(sizes > self.PLACES), np.flatnonzero(sizes <= self.PLACES)
        self.sizes = sizes[self.short]
        self.chars = np.unique(self._points("".join(names[i] for i in self.short)))
        self.bits = np.zeros((len(self.chars) + 1, len(self.short)), np.uint64)  # the last row is that of all other characters
        for column, i in enumerate(self.short):
            for place, row in enumerate(self._rows(names[i])):
                self.bits[row, column] |= np.uint64(1 << place)
        self.low = np.array([(1 << k) - 1 for k in range(self.PLACES + 1)], np.uint64)
        repeats = np.bitwise_count(self.bits)  # of each character in each name
        self.most = repeats.max(axis=1, initial=0).astype(np.int64)
        self.first = np.cumsum(self.most) - self.most  # the bit of a character's first repeat
        self.bags = self._bags(repeats)

    def _bags(self, repeats: np.ndarray) -> np.ndarray:
        """Words of bits (by columns of repeats) in which each character has as many bits set as it has repeats, `most` at most."""
        out = np.zeros((-(-int(self.most.sum()) // self.PLACES), repeats.shape[1]), np.uint64)
        if len(out) <= self.BAGS:
            for c in np.flatnonzero(self.most):
                for nth in range(self.most[c]):
                    part, bit = divmod(int(self.first[c]) + nth, self.PLACES)
                    out[part, repeats[c] > nth] |= np.uint64(1 << bit)
        return out

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _rows(self, text: str) -> np.ndarray:
        points = self._points(text)
        row = np.searchsorted(self.chars, points)
        return np.where(np.append(self.chars, 0)[row] == points, row, len(self.chars)) if len(self.chars) else np.zeros(len(points), np.int64)

    def similar(self, words: list[str]):
        """(word numbers, name numbers) of the pairs that are similar enough, in parts."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, rows in by.items():
            fits = lambda other, n=size: 2 * np.minimum(other, n) >= self.least * (other + n) - 1e-9
            near = np.flatnonzero(fits(self.sizes))
            plain = [i for i in self.long if fits(len(self.names[i]))]
            if size >= self.COMMON:
                plain, near = plain + self.short[near].tolist(), near[:0]
            for start in range(0, len(rows) if len(near) else 0, self.WORDS):
                part = rows[start : start + self.WORDS]
                codes = self._rows("".join(words[i] for i in part)).reshape(len(part), size)
                bags = self._bags(self._repeats(codes)) if len(self.bags) <= self.BAGS else None
                step, most = max(1, self.CELLS // len(near)), max(1, self.PAIRED // max(1, size))
                for at in range(0, len(part), step):
                    w, n = self._near(codes[at : at + step], near, bags if bags is None else bags[:, at : at + step])
                    for first in range(0, len(w), most):
                        i, j = (x[first : first + most] for x in (at + w, near[n]))
                        ok = self._ratios(codes[i], j) >= self.least
                        yield np.array(part)[i[ok]], self.short[j[ok]]
            if plain:
                yield self._matched([(i, words[i]) for i in rows], plain)

    def _repeats(self, codes: np.ndarray) -> np.ndarray:
        """How often each character of the names (in rows) stands in each word."""
        out = np.zeros((len(self.most), len(codes)), np.uint8)  # words are shorter than COMMON
        np.add.at(out, (codes, np.arange(len(codes))[:, None]), 1)
        return out

    def _near(self, codes: np.ndarray, near: np.ndarray, bags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The pairs with enough characters in common, and a longest common subsequence that is long enough."""
        least = np.ceil((self.least * (self.sizes[near] + codes.shape[1]) - 1e-9) / 2).astype(np.uint8)
        if bags is None:
            w, n = (x.ravel() for x in np.indices((len(codes), len(near))))
        else:
            w, n = np.nonzero(sum(np.bitwise_count(own[:, None] & names[near]) for own, names in zip(bags, self.bags, strict=True)) >= least)
        free = np.full(len(w), ~np.uint64(0))
        for place in range(codes.shape[1]):
            used = free & self.bits[codes[w, place], near[n]]
            free = (free + used) | (free - used)
        enough = np.bitwise_count(~free & self.low[self.sizes[near[n]]]) >= least[n]
        return w[enough], n[enough]

    def _ratios(self, codes: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The similarity of each row of codes to its name, or a lower bound of it once it is decided."""
        count, size = codes.shape
        equal = self.bits[codes, names[:, None]]  # for each place of the word the places of the name that are equal
        both = self.sizes[names] + size
        total = np.zeros(count, np.int64)
        pair, places = np.arange(count), np.arange(size)
        a, a_end, b, b_end = np.zeros(count, np.int64), self.sizes[names], np.zeros(count, np.int64), np.full(count, size)
        while len(pair):
            inside = (self.low[a_end] & ~self.low[a])[:, None]
            cells = np.where((places >= b[:, None]) & (places < b_end[:, None]), equal[pair] & inside, np.uint64(0))
            length, first, last = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.uint64), np.zeros(len(pair), np.int64)
            live, run, k = np.arange(len(pair)), cells, 0
            while True:  # run: bits of the places of the name where k + 1 equal characters end
                ends = np.bitwise_or.reduce(run, axis=1)
                has = ends != 0
                if not has.any():
                    break
                live, run, cells, ends, k = live[has], run[has], cells[has], ends[has], k + 1
                lowest = ends & (~ends + np.uint64(1))  # of the longest, the first in the name, then the first in the word
                length[live], first[live], last[live] = k, lowest, ((run & lowest[:, None]) != 0).argmax(axis=1)
                longer = np.zeros_like(run)
                longer[:, 1:] = cells[:, 1:] & (run[:, :-1] << np.uint64(1))
                run = longer
            np.add.at(total, pair, length)
            end, found = np.bitwise_count(first - np.uint64(1)).astype(np.int64) + 1, length > 0
            parts = [(pair, a, end - length, b, last + 1 - length), (pair, end, a_end, last + 1, b_end)]
            pair, a, a_end, b, b_end = (np.concatenate([left[found], right[found]]) for left, right in zip(*parts, strict=True))
            rest = np.minimum(a_end - a, b_end - b)
            most = total + np.bincount(pair, np.maximum(rest, 0), count).astype(np.int64)
            go = (rest > 0) & (2.0 * total[pair] / both[pair] < self.least) & (2.0 * most[pair] / both[pair] >= self.least)
            pair, a, a_end, b, b_end = pair[go], a[go], a_end[go], b[go], b_end[go]
        return 2.0 * total / both

    def _matched(self, words: list[tuple[int, str]], names: list[int]) -> tuple[np.ndarray, np.ndarray]:
        matcher, out = SequenceMatcher(), []
        for i, word in words:
            matcher.set_seq2(word)  # what the matcher prepares of a word serves all names
            for n in names:
                matcher.set_seq1(self.names[n])
                if matcher.quick_ratio() >= self.least and matcher.ratio() >= self.least:
                    out.append((i, n))
        return np.array([i for i, _ in out], np.int64), np.array([n for _, n in out], np.int64)


def similar_blocks(least: float):
    """A mapInArrow function: words, names (arrays of strings) -> word, name of the pairs whose similarity is at least `least`."""

    def run(batches):
        for batch in batches:
            for words, names in zip(batch["words"], batch["names"], strict=True):
                words, names = words.as_py(), names.as_py()
                for w, n in Names(names, least).similar(words):
                    yield pa.RecordBatch.from_arrays([pa.array(words).take(pa.array(w)), pa.array(names).take(pa.array(n))], ["word", "name"])

    return run


def similar_names(names: list[str], least: float, shortest: int, held: int = 500_000, rows: int = 500):
    """A mapInArrow function: doc_id, norm -> doc_id, numbers (places in names, ascending) of the names that a word (of at least `shortest` characters) of norm is similar to.

    What a word is similar to is a whole number with a bit for each name; those of up to
    about `held` words are remembered.
    """

    def run(batches):
        places: dict[str, int] = {}
        for i, name in enumerate(names):
            places[name] = places.get(name, 0) | 1 << i
        index, bits_of, known = Names(list(places), least), list(places.values()), {}
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = [{w for w in (t or "").split(" ") if len(w) >= shortest} for t in batch["norm"].to_pylist()]
                if len(known) > held:
                    known.clear()
                new = [w for w in set().union(*texts) if w not in known]
                known.update(dict.fromkeys(new, 0))
                for w, n in index.similar(new):
                    for i, j in zip(w.tolist(), n.tolist(), strict=True):
                        known[new[i]] |= bits_of[j]
                found = [np.zeros(0, np.int64)]
                for words in texts:
                    all_of = 0
                    for w in words:
                        all_of |= known[w]
                    bits = np.frombuffer(all_of.to_bytes(-(-len(names) // 8), "little"), np.uint8)
                    found.append(np.flatnonzero(np.unpackbits(bits, bitorder="little")))
                numbers = pa.ListArray.from_arrays(pa.array(np.cumsum([len(f) for f in found]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], numbers], ["doc_id", "numbers"])

    return run


def word_edits(left: list[str], right: list[str], limit: int, work: int = 4_000_000) -> tuple[int | None, int]:
    """(distance, lower bound): the word edit distance if it is at most limit and no more than `work` steps are needed, else None.

    Words become numbers.  For each number of edits the furthest place on each diagonal
    is kept, from which equal words are passed over a stretch at a time; so a pair takes
    as many steps as edits squared, and the words are only compared.
    """
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(w, len(codes)) for w in words], np.int64) for words in sorted((left, right), key=len))
    n, m = len(a), len(b)
    goal, steps = m - n, 0
    if goal > limit:
        return None, goal

    def passed(i: int, j: int) -> int:
        """The place in a up to which it equals b from places i and j on."""
        nonlocal steps
        size = 8
        while i < n and j < m:
            x, y = a[i : i + size], b[j : j + size]
            k = min(len(x), len(y))
            other = x[:k] != y[:k]
            steps += k
            if other.any():
                return i + int(other.argmax())
            i, j, size = i + k, j + k, min(size * 4, 1 << 14)
        return i

    front = {0: passed(0, 0)}
    for edits in range(limit + 1):
        if edits:
            reach = {}
            for d in range(max(-edits, -n), min(edits, m) + 1):
                i = max(front.get(d, -1) + 1, front.get(d - 1, -1), front.get(d + 1, -1) + 1)
                i = min(i, n, m - d)
                if i >= 0 and i + d >= 0:
                    reach[d] = passed(i, i + d)
            front = reach
            steps += len(reach)
        if front.get(goal, -1) >= n:
            return edits, edits
        if steps > work:
            return None, edits + 1
    return None, limit + 1


def edit_distances(limit: int):
    @F.pandas_udf("distance int, at_least int")
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        found = [word_edits(a.split(), b.split(), limit) for a, b in zip(left.fillna(""), right.fillna(""), strict=True)]
        return pd.DataFrame({"distance": pd.array([d for d, _ in found], "Int32"), "at_least": [b for _, b in found]})

    return run


class _Blocks(HTMLParser):
    """Text blocks of a page in order: (kind, level, text)."""

    LEAF = {"p": "paragraph", "li": "list_item", "td": "cell", "th": "cell", "div": "paragraph", "article": "paragraph", "section": "paragraph", "body": "paragraph", "nav": "paragraph", "tr": "", "table": "", "ul": "", "ol": "", "blockquote": "paragraph", "pre": "paragraph"} | {f"h{i}": "heading" for i in range(1, 7)}
    HIDDEN = {"script", "style", "head", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.kind, self.level, self.depth, self.hidden = [], [], "paragraph", 0, 0, 0

    def flush(self, kind="paragraph", level=0):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.parts, self.kind, self.level = [], kind, level

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        self.depth += tag in ("ul", "ol")
        if tag in self.LEAF:
            level = int(tag[1]) if self.LEAF[tag] == "heading" else max(0, self.depth - 1) if tag == "li" else 0
            self.flush(self.LEAF[tag] or "paragraph", level)
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        self.depth = max(0, self.depth - (tag in ("ul", "ol")))
        if tag in self.LEAF:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def page_blocks(html: str) -> list[tuple[str, int, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def html_rows(batches, at_once: int = 128):
    """mapInArrow: page_id, html -> page_id, pos, kind, level, text; a few pages at a time become rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, at_once):
            batch = whole.slice(at, at_once)
            found = [page_blocks(html.as_py()) for html in batch["html"]]
            sizes = [len(f) for f in found]
            kinds, levels, texts = zip(*(b for f in found for b in f), strict=True) if any(sizes) else ((), (), ())
            ids = batch["page_id"].take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            pos = np.concatenate([np.arange(n) for n in sizes])
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int64()), pa.array(kinds, pa.string()), pa.array(levels, pa.int64()), pa.array(texts, pa.string())], ["page_id", "pos", "kind", "level", "text"])


def resampling(size: int, out: int, lobes: int = 3) -> np.ndarray:
    """The matrix (out by size) that resamples a line of pixels by a windowed sinc, widened by the scale when the line shrinks; rows add up to one."""
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5)[:, None] * scale
    x = (np.arange(size)[None, :] + 0.5 - centre) / wide
    weight = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def shrunk(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """A grey image of whole numbers resampled along rows, then along columns, to whole numbers from 0 to 255."""
    whole = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    return whole(resampling(image.shape[0], rows) @ whole(image @ resampling(image.shape[1], columns).T))


def difference_bits(image: np.ndarray) -> int:
    """64 bits, the first one highest: in the image shrunk to 8 rows of 9, whether each pixel is lighter than its right neighbour."""
    small = shrunk(np.asarray(image, float), 8, 9)
    return int("".join("1" if b else "0" for b in (small[:, :-1] > small[:, 1:]).ravel()), 2)
