"""Hard negatives by best-first search in an R-tree packed by sort-tile-recursive order.

Vectors are whole numbers.  Spark deals them into tiles (slabs of the coordinate that
spreads most, each cut again by the next one) and writes them in order of tiles.  What a
task reads at once, thousands of rows, becomes a subtree: its coordinates are sorted and
cut in turn until leaves of one page are left.
Every node has a minimum bounding box.  Against an anchor a box gives an interval of
inner products, coordinate by coordinate; a queue takes the box with the highest end
first and drops those outside every score window that is still open, or strictly below
the kth score found so far.

Anchors are broadcast in blocks of bounded bytes, and each block visits all tiles; a
first look at a bounded share of the tiles gives kth scores that already bound the rest.
"""

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, staged, table

#: Rows of a leaf, rows of a tile, coordinates that Spark's tiles and those that subtrees are cut by.
LEAF, TILE, CUTS, INNER_CUTS = 128, 8192, 2, 3
#: Bytes of anchors that are broadcast at once, tiles that give the first bounds.
BLOCK_BYTES, FIRST_TILES = 8 << 20, 2
#: A score of whole numbers is exact in doubles below this.
EXACT = 1 << 53
POSITIVES, NEGATIVES = 5, 10


class Tree:
    """A subtree: leaves of rows with their boxes, and boxes of runs of leaves above them."""

    FAN = 16

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.concatenate(list(pack(vectors, ids, leaf)))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        starts = np.arange(0, len(ids), leaf)
        self.leaf = leaf
        self.low, self.high = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        tops = np.arange(0, len(starts), self.FAN)
        self.top_low, self.top_high = np.minimum.reduceat(self.low, tops), np.maximum.reduceat(self.high, tops)


def pack(vectors: np.ndarray, ids: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Row numbers in sort-tile-recursive order, in slabs that are whole leaves: sorted by one coordinate after another, those that spread most first."""
    by = np.argsort(-vectors.astype(float).std(axis=0), kind="stable")[:INNER_CUTS]

    def cut(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if depth == len(by) or pages <= 1:
            yield rows
            return
        rows = rows[np.lexsort((ids[rows], vectors[rows, by[depth]]))]
        slabs = round(pages ** (1 / (len(by) - depth)))
        step = leaf * -(-pages // max(slabs, 1))
        for i in range(0, len(rows), step):
            yield from cut(rows[i : i + step], depth + 1)

    return cut(np.arange(len(ids)), 0)


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any point of each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Best:
    """The first k of what is offered, by score descending, then id: what one anchor wants of one window of scores."""

    __slots__ = ("k", "low", "high", "heap", "bound")

    def __init__(self, k: int, low: float, high: float, bound: int | None):
        self.k, self.low, self.high, self.heap, self.bound = k, low, high, [], bound

    def least(self) -> float:
        """Scores strictly below this are of no use."""
        kth = self.heap[0][0] if len(self.heap) == self.k else self.low
        return max(self.low, kth if self.bound is None else max(kth, self.bound))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.least()) & (scores <= self.high))
        if len(fit) > self.k:
            fit = sorted(fit, key=lambda i: (-scores[i], ids[i]))[: self.k]
        for i in fit:
            item = (int(scores[i]), -int(ids[i]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)


def search(tree: Tree, vector: np.ndarray, wants: list[Best], same: bool, label: int, own: int, spans: tuple[np.ndarray, ...]) -> None:
    """Offers an anchor's wants all rows of the tree that can matter: those of its own label but itself, or those of other labels."""
    count, (low, high, top_low, top_high) = itertools.count(), spans

    def useful(lo: int, hi: int) -> bool:
        return any(hi >= w.least() and lo <= w.high for w in wants)

    queue = [(-hi, next(count), True, i) for i, (lo, hi) in enumerate(zip(top_low, top_high, strict=True)) if useful(lo, hi)]
    heapq.heapify(queue)
    while queue:
        bound, _, inner, i = heapq.heappop(queue)
        if inner:
            if useful(top_low[i], -bound):
                for j in range(i * tree.FAN, min((i + 1) * tree.FAN, len(low))):
                    if useful(low[j], high[j]):
                        heapq.heappush(queue, (-high[j], next(count), False, j))
            continue
        if not useful(low[i], -bound):
            continue
        rows = slice(i * tree.leaf, (i + 1) * tree.leaf)
        ids, fits = tree.ids[rows], tree.labels[rows] == label
        fits = fits & (ids != own) if same else ~fits
        scores, ids = (tree.vectors[rows] @ vector)[fits], ids[fits]
        for w in wants:
            w.offer(scores, ids)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v of the rows that take part: label and vector not null, every component a finite number; v is floor(256 x)."""
    x = F.col(vector_col).cast("array<double>")
    known = rows.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    known = known.where(F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True))))
    scaled = lambda c: F.when(F.abs(c * 256.0) < 2.0**52, F.floor(c * 256.0).cast("double")).otherwise(c * 256.0)  # noqa: E731  larger ones are whole
    return known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, scaled).alias("v"))


def tiled(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """tile, sub, id, label, v, written in order of tile and sub.

    The coordinates that spread most over all rows cut the space into slabs at
    approximate quantiles; a tile with more rows than twice `tile`, as equal vectors make
    one, is dealt out further by a hash of the id.
    """
    n = vectors.count()
    spread = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).orderBy(F.desc("s"), "i").limit(CUTS)
    by = [r["i"] for r in spread.collect()]  # CUTS rows
    slabs = round((n / tile) ** (1 / len(by))) if by else 1
    dealt = vectors.withColumn("tile", F.lit(0).cast("long"))
    for i in by if slabs > 1 else []:
        x = F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
        bounds = dealt.groupBy("tile").agg(F.percentile_approx(x, [k / slabs for k in range(1, slabs)], 10000).alias("bounds"))  # a number for each `tile` rows
        dealt = dealt.join(F.broadcast(bounds), "tile").select("id", "label", "v", (F.col("tile") * slabs + F.size(F.filter("bounds", lambda b, x=x: b < x))).alias("tile"))
    sizes = dealt.groupBy("tile").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (2 * tile))).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(sizes), "tile").withColumn("sub", F.pmod(F.xxhash64("id", "tile"), F.col("parts")).cast("int"))
    return staged(dealt.select("tile", "sub", "id", "label", "v").repartition("tile", "sub").sortWithinPartitions("tile", "sub", "id"), "tiles")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of one length; shorter ones end in zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def exact(vectors: np.ndarray, anchors: np.ndarray) -> bool:
    """Whether all sums of products stay below EXACT, so that doubles hold them."""
    return float(np.abs(vectors).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(vectors.shape[1], 1) < EXACT


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _found(tiles: DataFrame, block: dict, same: bool, leaf: int) -> DataFrame:
    """(anchor, want, id, score): what each task has of the first k rows of each want; an anchor is its place in the block."""
    shared = tiles.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        ids, labels, anchors = b["ids"], b["labels"], b["v"]
        best = [[Best(*w) for w in ws] for ws in b["wants"]]
        for batch in batches:
            if not len(batch):
                continue
            tree = Tree(batch["id"].to_numpy(), batch["label"].to_numpy(), matrix(batch["v"], anchors.shape[1]), leaf)
            v = anchors
            if not exact(tree.vectors, anchors):  # sums of any size, in Python's whole numbers
                v, tree.vectors, tree.low, tree.high, tree.top_low, tree.top_high = map(_whole, (anchors, tree.vectors, tree.low, tree.high, tree.top_low, tree.top_high))
            spans = (*intervals(v, tree.low, tree.high), *intervals(v, tree.top_low, tree.top_high))
            for i, wants in enumerate(best):
                if wants:
                    search(tree, v[i], wants, same, labels[i], ids[i], tuple(s[i] for s in spans))
        rows = [(i, j, -m, s) for i, wants in enumerate(best) for j, w in enumerate(wants) for s, m in w.heap]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "want", "id", "score"])

    return tiles.select("id", "label", "v").mapInArrow(run, "anchor int, want int, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """(anchor, want, best): of each want the first k, an array of (down, id) in order; tasks gave k each at most."""
    item = F.struct((-F.col("score")).alias("down"), "id")
    return found.groupBy("anchor", "want").agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("best"))


def _searched(tiles: DataFrame, look: DataFrame, block: dict, same: bool, k: int, leaf: int) -> DataFrame:
    """As _first, over all tiles; kth scores in the tiles of `look` bound the search of the others."""
    first = _first(_found(look, block, same, leaf), k).where(F.size("best") == k)
    kth = {(r["anchor"], r["want"]): r["kth"] for r in first.select("anchor", "want", (-F.element_at("best", -1)["down"]).alias("kth")).collect()}  # a number for each want of the block
    wants = [[(*w[:3], kth.get((i, j))) for j, w in enumerate(ws)] for i, ws in enumerate(block["wants"])]
    return _first(_found(tiles, block | {"wants": wants}, same, leaf), k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, low: int = 30, high: int = 90, positives: int = POSITIVES, negatives: int = NEGATIVES,
    tile: int = TILE, leaf: int = LEAF, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: id, label, v (whole numbers as doubles; shorter vectors are as if zeros
    followed; see whole_vectors for the rows that take part); is_anchor: a condition on
    these columns.  A score is the inner product with the anchor; higher come first, ties
    by smaller id.  An anchor's positives are its first `positives` rows of its label
    that have another id; a positive's negatives are the first `negatives` rows of other
    labels whose score is `low` to `high` percent of the positive's, both ends included,
    compared in whole numbers.  Anchors without positives and positives without negatives
    give no row; repeated rows are rows of their own, as anchors too; equal vectors are
    told by id; scores over 64 bits raise; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    tiles = tiled(staged(vectors.select("id", "label", "v"), "vectors"), tile)
    n, dims = tiles.where(is_anchor).count(), tiles.agg(F.max(F.size("v"))).first()[0] or 0
    keys = tiles.select("tile", "sub").distinct().orderBy(F.xxhash64("tile", "sub"), "tile", "sub").limit(FIRST_TILES)
    look = tiles.join(F.broadcast(keys), ["tile", "sub"], "left_semi")
    blocks = -(-n * (dims * 8 + 400) // block_bytes)
    dealt, paths = tiles.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(max(blocks, 1)))), []
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).select("id", "label", "v").toArrow()  # about block_bytes
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        block = {"ids": ids, "labels": labels, "v": matrix(rows["v"].combine_chunks(), dims)}
        every = [[(positives, -math.inf, math.inf, None)]] * len(ids)
        found = _searched(tiles, look, block | {"wants": every}, True, positives, leaf).collect()  # `positives` rows an anchor
        best = {r["anchor"]: [(-x["down"], x["id"]) for x in r["best"]] for r in found}
        wants = [[(negatives, -(-low * s // 100), high * s // 100, None) for s, _ in best.get(i, [])] for i in range(len(ids))]
        given = [(i, j, int(ids[i]), p, s) for i, ps in best.items() for j, (s, p) in enumerate(ps)]
        if not given:
            continue
        found = _searched(tiles, look, block | {"wants": wants}, False, negatives, leaf)
        named = spark.createDataFrame(given, "anchor int, want int, anchor_id long, positive_id long, positive_score long")
        told = found.join(F.broadcast(named), ["anchor", "want"]).select("anchor_id", "positive_id", F.posexplode("best").alias("nth", "x"), "positive_score")
        told = told.select("anchor_id", "positive_id", (F.col("nth") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.down")).alias("negative_score"))
        paths.append(new_dir(spark, "negatives"))
        told.write.parquet(paths[-1])
    return spark.read.schema(out).parquet(*paths) if paths else spark.createDataFrame([], out)


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(whole_vectors(rows), F.col("id") % 100 == 0)


#: The same by comparing every anchor with every row.
OP12_SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS MATERIALIZED (SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM s WHERE label = own AND id <> anchor_id) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
