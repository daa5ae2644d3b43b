"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each distinct five-word shingle is hashed once; the hash names a bin and a value,
and a bin keeps its least value.  An empty bin takes the value of the bin that its
own fixed sequence of probes meets first, so two texts copy alike.  Four low-order
bits of every bin's value mixed with the bin's number are stored, so copies of one
value differ.  Two different values agree in four bits once in 16 times,
independently in each bin, which `likeness` takes out again.
"""

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, n_partitions, only, ordered_partitions, shingles, table

BINS, BITS = 512, 4
#: What a text without words has instead of a fingerprint.
NO_WORDS = ""
_BIN_MARKS = mix(np.arange(1, BINS + 1, dtype=np.uint64))
_PROBES: list[np.ndarray] = []


def _probes(i: int) -> np.ndarray:
    """Block i of the bins' probe sequences: 32 probes for each bin."""
    while len(_PROBES) <= i:
        step = np.arange(len(_PROBES) * 32, len(_PROBES) * 32 + 32, dtype=np.uint64)[:, None]
        bins = np.arange(BINS, dtype=np.uint64)[None, :]
        _PROBES.append((mix(step * np.uint64(1 << 20) + bins + np.uint64(77)) % np.uint64(BINS)).astype(np.int64))
    return _PROBES[i]


def bins_of(hashes: np.ndarray) -> np.ndarray:
    """The densified bins of a set of shingle hashes (not empty)."""
    h = np.sort(hashes)
    at = (h >> np.uint64(55)).astype(np.int64)
    lead = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    value, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[at[lead]], full[at[lead]] = h[lead], True
    if len(lead) == 1:
        return np.full(BINS, h[0])
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        probe = _probes(block)[:, empty]
        hit = full[probe]
        found = hit.any(axis=0)
        got = probe[hit.argmax(axis=0), np.arange(len(empty))]
        value[empty[found]] = value[got[found]]
        empty, block = empty[~found], block + 1
    return value


def fingerprint(text: str | None) -> str:
    """Hexadecimal digits, one for each bin, or NO_WORDS; equal texts have equal fingerprints."""
    h = shingles(text)
    if not len(h):
        return NO_WORDS
    low = (mix(bins_of(h) ^ _BIN_MARKS) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return ((low[0::2] << 4) | low[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The estimated Jaccard likeness of two texts' shingle sets, from 0 to 1."""
    if NO_WORDS in (a, b):
        return float(a == b)
    x = np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8)
    same = (np.count_nonzero((x & 15) == 0) + np.count_nonzero((x >> 4) == 0)) / BINS
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def edited(text: str, after: str) -> str:
    """The last quarter of a text's code points (rounded down) replaced by as many first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _walk(batches):
    """Rows come by part and order, the last of a part being the first row of the next part (tail)."""
    only()
    prev = None
    for pdf in batches:
        out = []
        for part, doc, text, tail in zip(pdf["part"], pdf["doc"], pdf["text"], pdf["tail"], strict=True):
            print_ = fingerprint(text)
            if prev and prev[0] == part:
                _, p_doc, p_text, p_print = prev
                new = edited(p_text, text)
                new_print = fingerprint(new)
                digest = sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((p_doc, len(p_text), digest, p_print, new_print, likeness(p_print, new_print), likeness(p_print, print_)))
            prev = None if tail else (part, doc, text, print_)
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, which ends with the start of the next document.

    The next document is the one with the next id; rows with one id are in order of
    their texts, null ids come first, and the first row follows the last.  A null text
    is an empty one; texts without words have an empty fingerprint and are like each
    other and nothing else.  An empty table gives an empty result; other columns are
    ignored.  Documents are dealt once to ordered parts; each part also gets the first
    document of the next part, so no part needs another one's rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = n_partitions(spark)
    cuts = np.array(ordered_partitions(rows, "doc", n), np.int64)

    @F.pandas_udf("int")
    def part_of(doc: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, doc.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series(np.where(doc.isna(), 0, at))

    order = F.struct(F.col("doc").isNotNull().alias("known"), "doc")
    parts = rows.select("doc", part_of("doc").alias("part"))
    heads = [(r["part"], r["head"]["doc"]) for r in parts.groupBy("part").agg(F.min(order).alias("head")).orderBy("part").collect()]  # a row per part
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    before = [(doc, heads[i - 1][0]) for i, (_, doc) in enumerate(heads)]
    to = spark.createDataFrame([(d, p) for d, p in before], "head long, part int")
    tails = rows.join(F.broadcast(to), rows["doc"].eqNullSafe(to["head"])).groupBy("doc", "part").agg(F.min("text").alias("text")).select("doc", "text", "part", F.lit(True).alias("tail"))
    dealt = rows.select("doc", "text", part_of("doc").alias("part"), F.lit(False).alias("tail")).union(tails)
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "tail", F.col("doc").asc_nulls_first(), "text")
    return dealt.mapInPandas(_walk, SCHEMA)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
