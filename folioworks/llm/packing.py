"""Packing documents into sequences of one length by multiway differencing (Karmarkar and Karp).

Documents are tokenised once and dealt to groups of a few hundred by a hash of
the row and, among equal rows of a task, their number.  Inside a group full sequences are cut off long documents, and what is
left of each document is an item.  Every item starts as a partial partition with
one filled window; the two partial partitions with the greatest imbalance merge
over and over, the fullest windows of one with the emptiest of the other, until one
partition of near-equal windows is left.  If a window is over capacity the number of
windows rises and the group is partitioned again.
"""

import heapq
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, n_partitions, table
from .tokens import word_ids

LENGTH = 2048
#: Documents in a group, on average.
GROUP = 384


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of item numbers with near-equal sums of sizes."""
    if k <= 1:
        return [list(range(len(sizes)))]
    # a partial partition: the sums of its k windows in descending order, less the least one
    sums = np.zeros((len(sizes), k), np.int64)
    sums[:, 0] = sizes
    parts = dict(enumerate(sums))
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = parts.pop(a) + parts.pop(b)[::-1]  # the fullest windows of one meet the emptiest of the other
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        new = len(sizes) + len(merged)
        parts[new] = both
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), new))
    # back through the merges: which window of the whole each window of a partial partition is
    place = {heap[0][1]: np.arange(k)} if heap else {}
    for new in range(len(sizes) + len(merged) - 1, len(sizes) - 1, -1):
        a, b, order = merged[new - len(sizes)]
        own = np.empty(k, np.int64)
        own[order] = place.pop(new)
        place[a], place[b] = own, own[::-1]
    windows: list[list[int]] = [[] for _ in range(k)]
    for i in range(len(sizes)):
        windows[place[i][0]].append(i)
    return windows


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of items, none over capacity: the number rises until all fit."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        found = difference(sizes, k)
        worst = max(sum(sizes[i] for i in w) for w in found)
        if worst <= capacity:
            return [w for w in found if w]
        k += max(1, round(k * (worst - capacity) / capacity / 2))


def _pack(capacity: int, wide: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "n"], kind="stable")
        group, out, at, rest = int(key[0]) << 32, [], 0, []
        ids = pdf["ids"].tolist()
        lens = [len(x) // wide for x in ids]
        for row, n in enumerate(lens):
            full = n // capacity
            for j in range(full):
                out.append((row, j * capacity, capacity, group + at, 0))
                at += 1
            if n > full * capacity:
                rest.append((row, full * capacity, n - full * capacity))
        for window in windows_of([r[2] for r in rest], capacity) if rest else []:
            offset = 0
            for i in window:
                row, start, n = rest[i]
                out.append((row, start, n, group + at, offset))
                offset += n
            at += 1
        rows = np.array([o[0] for o in out], np.int64)
        kind = np.dtype("<u2" if wide == 2 else "<u4")
        return pd.DataFrame(
            {
                "doc_id": pdf["doc"].astype("Int64").to_numpy()[rows],
                "start": [o[1] for o in out],
                "length": [o[2] for o in out],
                "doc_tokens": np.array(lens, np.int64)[rows],
                "sequence_id": [o[3] for o in out],
                "offset": [o[4] for o in out],
                "ids": [np.frombuffer(ids[o[0]], kind, o[2], o[1] * wide).astype("<u4").tobytes() for o in out],
            }
        )

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is the ids of its whole text (null: empty) and end_id.  Pieces lie one
    after another in their sequence from offset 0; ids is the piece as little-endian
    unsigned 32-bit numbers.  Only documents longer than `capacity` are cut, into full
    sequences and a rest.  Rows with the same id, and equal rows, are packed one by one
    and dealt to different groups; a null id is kept; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    groups = max(1, -(-rows.count() // GROUP))
    wide = word_ids(tokenizer).dtype.itemsize

    def encode(batches):
        enc, seen = word_ids(tokenizer), Counter()
        for batch in batches:
            nth = []
            for x in batch["h"].to_numpy().tolist():  # equal rows of a task get numbers, in whatever order they come
                nth.append(seen[x])
                seen[x] += 1
            h = mix(batch["h"].to_numpy().view(np.uint64) + np.array(nth, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            at = 0
            for ids in enc.encode_column(batch["text"], end_id):
                here = slice(at, at + len(ids))
                n = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]) // wide
                yield pa.RecordBatch.from_arrays([batch["doc"].slice(at, len(ids)), pa.array(h[here].view(np.int64)), ids, pa.array(n, pa.int32())], ["doc", "h", "ids", "n"])
                at += len(ids)

    hashed = rows.withColumn("h", F.xxhash64("doc", "text", F.spark_partition_id()))
    coded = hashed.mapInArrow(encode, "doc long, h long, ids binary, n int")
    dealt = coded.withColumn("grp", F.pmod(F.xxhash64("h"), F.lit(groups))).repartition(max(n_partitions(docs.sparkSession), 1), "grp")
    return dealt.groupBy("grp").applyInPandas(_pack(capacity, wide), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
