"""What the operators of this subpackage share: staging, words, ordered partitions, components."""

import ctypes
import gc
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = re.compile(r"\w+")
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a local one is made only where none is set and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: later jobs don't repeat the work, whichever executors are lost."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ordered_partitions(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending boundaries that cut a whole-number column into about equal parts; only that column is read."""
    at = [i / n for i in range(1, n)]
    if not at:
        return []
    found = df.select(F.percentile_approx(key, at, 10000)).first()[0] or []
    return sorted(set(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """A 64-bit hash of each word, kept while the Python worker lives."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = WordHashes()
#: All dictionaries that outlive a task in this Python worker.
CACHES: list[dict] = [_HASHES]


def give_back() -> None:
    """Returns freed memory of this Python worker to the system; idle workers stand beside the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def only(cache: dict = _HASHES) -> None:
    """Empties the other dictionaries: a worker that goes from one operator's tasks to another's holds one at a time."""
    for c in CACHES:
        if c is not cache:
            c.clear()
    give_back()


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; where there are none, what stands between white space."""
    text = (text or "").lower()
    return _WORDS.findall(text) or text.split()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """A hash for each run of `size` words, repeats included; a shorter text is one shingle, one without words has none."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


#: A key is hot if it has so many rows and this share of all of them; so there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 500, 0.005


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: int) -> DataFrame:
    """rows joined with keyed, in which `count` says how many of the n rows have the key; a few rows a key.

    What belongs to hot keys, at most 1 / HOT_SHARE of them, is broadcast, so the rows of
    one key are not brought to one task; the others are joined by key.
    """
    hot = F.col("count") > max(HOT_ROWS, int(HOT_SHARE * n))
    few, many = F.broadcast(keyed.where(hot).drop("count")), keyed.where(~hot).drop("count")
    cold = rows.join(F.broadcast(keyed.where(hot).select(*on).distinct()), on, "left_anti")
    return rows.join(few, on).unionByName(cold.join(many, on))


def with_least(edges: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """(u, v, m) for every edge (u, v): m is the least v among u's edges in `of`, which has n rows and all u."""
    least = of.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
    return join_hot(edges.select("u", "v"), least, ["u"], n)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in an edge (a, b): root is the least id that it is linked to, over any number of links.

    Alternating large-star and small-star rounds; the edges of each half round are
    written to the shared folder.  No edge list or component reaches the driver or one
    task: a round is two grouped minima with partial aggregation and two joins, in which
    hubs are broadcast minima.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, n = None, now.count()
    while n:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both.where("v > u"), both, 2 * n).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = staged(large, "stars")
        small = with_least(large, large, n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = staged(small.where("u <> v").distinct(), "edges")
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == seen:
            break
        seen = (n, mark)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
