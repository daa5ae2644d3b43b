"""Which of many needles stand in which texts: an index of anchor grams.

A needle of more than GRAM characters is keyed by one run of GRAM characters, that which
the texts have least often; a shorter one by itself.  Texts are read with rolling hashes,
so no run longer than GRAM is ever made: a first reading counts the needles' runs, a
second one looks anchors up, first in a bit set of bounded size, and compares whole
needles where an anchor stands.  The index of anchors is sent to the workers as long as
it is small; beyond that, texts and needles meet by joins on anchors.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import Bits, bit_set, mix
from ..sources.staging import kept

GRAM = 6
#: Bytes of needles that are sent to the workers.
SENT = 64 << 20
#: Characters of texts that are looked at together: their hashes stay in a core's cache.
PART = 1 << 17
#: Characters of a needle that are compared for all places at once.
SHORT = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Line:
    """Texts side by side as code points, and the hashes of their runs of 1 to GRAM characters."""

    def __init__(self, field: str, texts: list[str]):
        self.text = "\0".join(texts)
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.salt = np.uint64(sum(b << (8 * (i % 7)) for i, b in enumerate(field.encode())) & 0xFFFFFFFF)

    def runs(self, lengths):
        """(length, hash at each place) for each of the lengths, ascending."""
        h = np.zeros(len(self.codes), np.uint64)
        for k in range(1, max(lengths, default=0) + 1):
            h = h[: max(len(self.codes) - k + 1, 0)] * _BASE + self.codes[k - 1 :]
            if k in lengths:
                yield k, mix(h + (self.salt << np.uint64(8)) + np.uint64(k))

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _lines(batch: pa.RecordBatch, column: str):
    """(field, row numbers, Line) of parts of a batch."""
    fields, texts = batch["field"].to_pylist(), batch[column].to_pylist()
    by: dict[str, list[int]] = {}
    for i, f in enumerate(fields):
        if texts[i]:
            by.setdefault(f, []).append(i)
    for field, rows in by.items():
        part, size = [], 0
        for i in rows:
            part.append(i)
            size += len(texts[i])
            if size >= PART:
                yield field, np.array(part), Line(field, [texts[j] for j in part])
                part, size = [], 0
        if part:
            yield field, np.array(part), Line(field, [texts[j] for j in part])


def _record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def needle_runs(needles: DataFrame) -> DataFrame:
    """field, needle, k, h, at: each run of a long needle, or a short one itself."""

    def run(batches):
        for batch in batches:
            for _, rows, line in _lines(batch, "needle"):
                sizes = line.ends - line.starts
                for k, h in line.runs(set(range(1, GRAM + 1))):
                    own = np.flatnonzero(sizes == k) if k < GRAM else np.flatnonzero(sizes >= k)
                    n = sizes[own] - k + 1
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    which = np.repeat(own, n)
                    there = pa.array(rows[which])
                    yield _record("field needle k h at", batch["field"].take(there), batch["needle"].take(there), pa.array(np.full(len(at), k), pa.int32()), h[line.starts[which] + at].view(np.int64), pa.array(at, pa.int32()))

    return needles.select("field", "needle").mapInArrow(run, "field string, needle string, k int, h long, at int")


def run_counts(hay: DataFrame, wanted: Bits) -> DataFrame:
    """h, n: how often runs of GRAM characters of the set stand in the texts."""
    shared = hay.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            parts = [h[shared.value.has(h)] for _, _, line in _lines(batch, "hay") for _, h in line.runs({GRAM})]
            found, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield _record("h n", found.view(np.int64), n)

    return hay.select("field", "hay").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def anchors(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """field, needle, k, h, at: the anchor of each needle; long ones with a run that no text has are left out."""
    runs = kept(needle_runs(needles), "runs")
    long = F.length("needle") > GRAM
    counted = runs.where(long).join(run_counts(hay, bit_set(runs.where(long).select("h").distinct())), "h", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "h", "at")).alias("a")
    of_long = counted.groupBy("field", "needle").agg(rarest).where("a.n > 0").select("field", "needle", "a.k", "a.h", "a.at")
    return kept(runs.where(~long).select("field", "needle", "k", "h", "at").union(of_long), "anchors")


class Index:
    """Anchors in order of their hashes, with what is compared where one stands."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["h"].to_numpy().view(np.uint64), kind="stable")
        h = table["h"].to_numpy().view(np.uint64)[order]
        self.hashes, self.first = np.unique(h, return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.at, self.fields, self.needles = table["at"].to_numpy()[order].astype(np.int64), table["field"].take(pa.array(order)).to_pylist(), table["needle"].take(pa.array(order)).to_pylist()
        self.of_field = {f: np.array([g == f for g in self.fields], bool) for f in set(self.fields)}
        self.sizes = np.array([len(n) for n in self.needles], np.int64)
        self.heads = np.zeros((len(self.needles), SHORT), np.uint32)  # the first characters of each needle
        for i, n in enumerate(self.needles):
            head = np.frombuffer(n[:SHORT].encode("utf-32-le", "surrogatepass"), np.uint32)
            self.heads[i, : len(head)] = head

    def places(self, h: np.ndarray, wanted: Bits) -> tuple[np.ndarray, np.ndarray]:
        """(place, anchor) for each place whose hash is an anchor's."""
        at = np.flatnonzero(wanted.has(h))
        slot = np.searchsorted(self.hashes, h[at]).clip(0, max(len(self.hashes) - 1, 0))
        same = self.hashes[slot] == h[at] if len(self.hashes) else np.zeros(0, bool)
        return at[same], slot[same]

    def heads_at(self, field: str, line: Line, at: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, needle, start) of the field's needles that fit where their anchors stand and whose first SHORT characters are there."""
        n = self.last[slots] - self.first[slots]
        which = np.repeat(self.first[slots] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows, starts = np.repeat(line.rows(at), n), np.repeat(at, n) - self.at[which]
        ok = np.flatnonzero(self.of_field[field][which] & (starts >= line.starts[rows]) & (starts + self.sizes[which] <= line.ends[rows])) if field in self.of_field else np.zeros(0, np.int64)
        for k in range(SHORT):
            i, long = which[ok], self.sizes[which[ok]] > k
            same = ~long
            same[long] = line.codes[starts[ok[long]] + k] == self.heads[i[long], k]
            ok = ok[same]
        return rows[ok], which[ok], starts[ok]


def _checked(hay: DataFrame, found: DataFrame, wanted: Bits, lengths: set[int]) -> DataFrame:
    """Needles looked for by an index that every worker has."""
    shared = hay.sparkSession.sparkContext.broadcast((Index(found.select("field", "needle", "h", "at").toArrow()), wanted))

    def run(batches):
        index, bits = shared.value
        for batch in batches:
            for field, rows, line in _lines(batch, "hay"):
                seen: set[tuple[int, int]] = set()
                for _, h in line.runs(lengths):
                    rows_, which, starts = index.heads_at(field, line, *index.places(h, bits))
                    whole = index.sizes[which] <= SHORT
                    seen.update(divmod(x, len(index.needles)) for x in np.unique(rows_[whole] * len(index.needles) + which[whole]).tolist())
                    for row, i, start in zip(rows_[~whole].tolist(), which[~whole].tolist(), starts[~whole].tolist(), strict=True):
                        if (row, i) not in seen and line.text.startswith(index.needles[i], start):
                            seen.add((row, i))
                rows_, which = [r for r, _ in seen], [i for _, i in seen]
                yield _record("doc_id field needle", batch["doc_id"].take(pa.array(rows[rows_] if rows_ else [], pa.int64())), pa.array([field] * len(which), pa.string()), pa.array([index.needles[i] for i in which], pa.string()))

    return hay.mapInArrow(run, f"doc_id {hay.schema['doc_id'].dataType.simpleString()}, field string, needle string")


def _joined(hay: DataFrame, found: DataFrame, wanted: Bits, lengths: set[int]) -> DataFrame:
    """Needles looked for by joins: documents give the anchors they may have, then whole needles are compared."""
    shared = hay.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for field, rows, line in _lines(batch, "hay"):
                for _, h in line.runs(lengths):
                    at = np.flatnonzero(shared.value.has(h))
                    which = np.unique(np.rec.fromarrays([rows[line.rows(at)], h[at]], names="row,h"))
                    yield _record("doc_id field h", batch["doc_id"].take(pa.array(which["row"])), pa.array([field] * len(which), pa.string()), which["h"].view(np.int64))

    hits = hay.mapInArrow(run, f"doc_id {hay.schema['doc_id'].dataType.simpleString()}, field string, h long").distinct()
    near = hits.join(found.select("field", "h", "needle"), ["field", "h"]).select("doc_id", "field", "needle")
    return near.join(hay, ["doc_id", "field"]).where("contains(hay, needle)").select("doc_id", "field", "needle")


def find_needles(hay: DataFrame, needles: DataFrame, sent: int = SENT) -> DataFrame:
    """Distinct (doc_id, field, needle) for which the needle stands in a text of that document and field.

    hay: doc_id, field, hay; needles: field, needle.  Any characters and lengths are
    compared as they are; null and empty needles and texts have nothing; repeated rows
    count once.  `sent` bounds the bytes of needles that go to all workers.
    """
    hay = hay.select("doc_id", "field", "hay").where("hay <> ''")
    needles = needles.select("field", "needle").where("needle <> ''").distinct()
    found = anchors(hay, needles)
    size = found.agg(F.coalesce(F.sum(F.octet_length("needle") + F.octet_length("field") + 24), F.lit(0))).first()[0]
    lengths = {r["k"] for r in found.select("k").distinct().collect()}  # GRAM at most
    wanted = bit_set(found.select("h").distinct())
    return (_checked if size <= sent else _joined)(hay, found, wanted, lengths).distinct()
