"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Old shard sizes and new capacities are the supplies and demands of a small flow
network (one node a shard on each side; staying is free, moving costs a unit a byte
or what a cost table says).  The flow is realised on the rows: the rows of an old
shard have a fixed order, and each outgoing flow is an interval of its running byte
count.  Running counts come from sums of blocks (class of size, slice of a hash), so
only the few blocks that an interval's end falls into are looked at row by row; the
ends become keys of the order, and each row finds its new shard from those keys.
"""

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_dir, table

SHARDS = 40
#: Hash slices in a block of one class of sizes.
SLICES = 64


def min_cost_flow(supply: list[int], demand: list[int], cost: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Flow (old, new) -> bytes of least total cost; sums of supply and demand must agree.

    Successive shortest paths with node prices on source, old nodes, new nodes, sink.
    """
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    source, sink, size = n + m, n + m + 1, n + m + 2
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(size)]

    def edge(u: int, v: int, cap: int, c: int) -> int:
        for a, b, k, w in ((u, v, cap, c), (v, u, 0, -c)):
            out[a].append(len(to))
            to.append(b)
            room.append(k)
            price.append(w)
        return len(to) - 2

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    total = sum(supply)
    at = {(i, j): edge(i, n + j, total, cost[i, j] if cost else int(i != j)) for i in range(n) for j in range(m)}
    potential = [0] * size
    left = total
    while left:
        far = [1 << 62] * size
        via = [-1] * size
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in out[u]:
                if room[e] and (x := d + price[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(queue, (x, to[e]))
        for v in range(size):
            if far[v] < 1 << 62:
                potential[v] += far[v]
        push, v = left, sink
        while v != source:
            push, v = min(push, room[via[v]]), to[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
        left -= push
    return {k: room[e ^ 1] for k, e in at.items() if room[e ^ 1]}


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def _key(small_first: bool) -> Column:
    """The order of rows in an old shard: class of size, then a hash, then the id."""
    group = F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int")
    return F.struct((group if small_first else -group).alias("cls"), F.col("h").alias("h"), F.col("id").alias("id"))


def rebalance(rows: DataFrame, n_old: int, capacities: list[int] | None, n_new: int, small_first: bool) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(old, cuts, to): of each old shard the keys that its order is cut at and the new shard of each interval; and the flow.

    rows: id, h (0 to 2^62), size, old.  The answer has a row per old shard.
    """
    spark = rows.sparkSession
    base = rows.select("id", "h", "size", "old").withColumn("key", _key(small_first))
    base = base.withColumn("slice", F.shiftright("h", 56).cast("int"))
    blocks = base.groupBy("old", F.col("key.cls").alias("cls"), "slice").agg(F.sum("size").alias("bytes"))
    sums = blocks.withColumn("end", F.sum("bytes").over(W.partitionBy("old").orderBy("cls", "slice")))
    supply = [0] * n_old
    for r in blocks.groupBy("old").agg(F.sum("bytes").alias("b")).collect():  # a row per shard
        supply[r["old"]] = int(r["b"])
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), n_new))
    # intervals of the running count: what stays is last if small rows move first, else first
    marks, order = [], {}
    for i in range(n_old):
        parts = sorted(((j, b) for (o, j), b in flow.items() if o == i), key=lambda p: ((p[0] == i) if small_first else (p[0] != i), p[0]))
        run, order[i] = 0, [j for j, _ in parts] or [min(i, n_new - 1)]
        for k, (_, b) in enumerate(parts[:-1]):
            run += b
            marks.append((i, k, run))
    cuts: dict[int, dict[int, tuple]] = {i: {} for i in range(n_old)}
    if marks:  # fewer than old plus new shards
        at = F.broadcast(spark.createDataFrame(marks, "old int, k int, mark long"))
        inside = sums.join(at, "old").where("end - bytes < mark and mark <= end").select("old", "cls", "slice", "k", "mark", (F.col("end") - F.col("bytes")).alias("start"))
        found = inside.collect()
        inner = base.withColumn("cls", F.col("key.cls")).join(F.broadcast(spark.createDataFrame(found, inside.schema)), ["old", "cls", "slice"])
        run = F.col("start") + F.sum("size").over(W.partitionBy("old", "k").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
        # a row lies before the mark if at least half of it does
        half = inner.withColumn("run", run).where("run - size / 2 <= mark").groupBy("old", "k").agg(F.max("key").alias("key"))
        for r in found:
            cuts[r["old"]][r["k"]] = (r["cls"], (r["slice"] << 56) - 1, 1 << 62)
        for r in half.collect():
            cuts[r["old"]][r["k"]] = tuple(r["key"])
    moves = [(i, [cuts[i][k] for k in range(len(order[i]) - 1)], order[i]) for i in range(n_old)]
    return spark.createDataFrame(moves, "old int, cuts array<struct<cls:int,h:long,id:long>>, to array<int>"), flow


def moved(rows: DataFrame, moves: DataFrame, small_first: bool) -> DataFrame:
    """rows with old replaced by the new shard: each row finds its interval between its old shard's cuts."""
    key = _key(small_first)
    nth = F.size(F.filter("cuts", lambda c: c < F.col("key")))
    got = rows.withColumn("key", key).join(F.broadcast(moves), "old").withColumn("old", F.get("to", nth))
    return got.drop("key", "cuts", "to")


def reshard(docs: DataFrame, old: Column, n_old: int, n_new: int, path: str, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Writes docs into n_new shards under path and returns them as read back, with the flow of the first pass.

    Columns: doc_id, text, old_shard, shard, slot (gapless from 0 by doc_id in a shard).
    Sizes are UTF-8 bytes of the text (null: none) plus 16 a row.  A first flow moves the
    fewest bytes to equal (or given) capacities; as rows don't split, a second flow over
    the sizes that came out moves the smallest rows to even out what is left.  Every row
    is placed by itself, by a hash of its id, size and place in the table: equal rows and
    equal texts go to any shards, as a text with a third of all rows would else make
    equal sizes impossible.  Null ids are in order before others; rows of one id by
    their hash; an empty table gives an empty result; other columns are ignored.  Files
    of a shard are written by as many tasks as there are sub-shards, also for an id with
    very many rows, so no task holds a whole shard or id.  docs is read several times and
    must give the same rows in the same partitions, as tables of files do.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), old.cast("int").alias("old_shard"))
    sized = rows.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, "id": F.coalesce("doc_id", F.lit(-(1 << 62)))})
    sized = sized.withColumn("h", F.xxhash64("id", "size", F.monotonically_increasing_id()).bitwiseAND((1 << 62) - 1))
    light = sized.select("id", "h", "size", F.col("old_shard").alias("old"))
    first, flow = rebalance(light, n_old, capacities, n_new, small_first=False)
    second, _ = rebalance(moved(light, first, False), n_new, capacities, n_new, small_first=True)
    placed = moved(moved(sized.withColumn("old", F.col("old_shard")), first, False), second, True).withColumnRenamed("old", "shard")
    n_sub = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // n_new))
    cut = F.percentile_approx("id", [i / n_sub for i in range(1, n_sub)], 10000) if n_sub > 1 else F.array().cast("array<bigint>")
    bounds = sorted(placed.agg(cut.alias("c")).first()["c"] or [])
    # a bound that comes several times is an id with many rows: its hashes are cut into as many parts
    sub = sum(((F.col("id") > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    for b in sorted(set(bounds)):
        if (many := bounds.count(b)) > 1:
            sub += F.when(F.col("id") == b, F.shiftright("h", 40) * (many + 1) / (1 << 22)).otherwise(0).cast("int")
    placed = placed.withColumn("sub", sub)
    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("sub")) - F.col("n")).select("shard", "sub", "base")
    inner = F.row_number().over(W.partitionBy("shard", "sub").orderBy("id", "h"))
    numbered = placed.withColumn("nth", inner).join(F.broadcast(counts), ["shard", "sub"])  # shards times sub-shards rows
    ready = numbered.select("doc_id", "text", "old_shard", (F.col("base") + F.col("nth") - 1).alias("slot"), "shard")
    ready.write.partitionBy("shard").parquet(path)
    return spark.read.schema(ready.schema).parquet(path), flow


def op4_reshard(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(SHARDS))
    back, _ = reshard(docs, old, SHARDS, SHARDS, new_dir(spark, "shards"))
    return back.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
