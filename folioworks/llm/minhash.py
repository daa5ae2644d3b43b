"""Near-duplicate classes of documents by BagMinHash signatures over word shingles.

A document is the multiset of its five-word shingles.  Every shingle carries
Poisson processes over its weight axis, one for each of the intervals (0,1],
(1,2], (2,4], (4,8], ...: the first split of the axis into nested intervals.
The points of an interval come in ascending time, each with a unit of weight
inside the interval and one of the signature's slots.  A text that holds the
shingle w times takes the points whose unit is at most w, so a slot's first
point is the same in two texts with a chance equal to the overlap of the
multisets (sum of least counts over sum of greatest counts).  Only points before
the time by which all slots are expected to be filled are made; where a slot
stays empty the horizon doubles.

Slots are banded; texts that share a band are candidates.  In each band the
members are linked to one hub, verified on the real multisets, and grouped.  Bands
that then still have members in different groups are compared exactly, block against block,
so every pair that shares a band is in one group or was decided on its multisets.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, give_back, join_hot, mix, only, shingles, staged, table, with_least

#: Slots of a signature, and slots in a band. At an overlap of 0.8 the chance to share none of 24 bands is 3e-6.
SLOTS, ROWS = 96, 4
#: Texts in a block, on average.
BLOCK = 192


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """n_docs rows of slots: the mark of each slot's first point, for multisets given as rows of doc, hash, count; no doc may be empty.

    All documents go through the rounds together: in each round every live interval
    moves to its next point, and is dropped when that lies beyond its document's horizon.
    """
    # the intervals of the weight axis that a count reaches: number j is (2**(j-1), 2**j], number 0 is (0, 1]
    reach = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    who = np.repeat(np.arange(len(hashes)), reach)
    level = np.arange(len(who)) - np.repeat(np.cumsum(reach) - reach, reach)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, width, 0.0)
    weight, owner = counts[who].astype(np.float64), doc[who]
    seed = mix(hashes[who] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((n_docs, slots), np.uint64)
    horizon = slots / np.bincount(doc, counts, n_docs) * (np.log(slots) + 2.5)
    open_docs = np.ones(n_docs, bool)
    while open_docs.any():
        live = np.flatnonzero(open_docs[owner])
        time, state = np.zeros(len(live)), seed[live]
        times, places, marks = [], [], []
        while len(live):
            state = mix(state + np.uint64(0xD1B54A32D192ED03))
            time = time - np.log(_uniform(state)) / width[live]
            keep = np.flatnonzero(time <= horizon[owner[live]])
            live, time, state = live[keep], time[keep], state[keep]
            point = mix(state ^ np.uint64(0xA0761D6478BD642F))
            place = owner[live] * slots + ((point >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
            used = np.ones(len(live), bool)
            wide = np.flatnonzero(width[live] > 1)  # an interval of one unit is used whole
            used[wide] = low[live[wide]] + np.floor(_uniform(mix(point[wide])) * width[live[wide]]) + 1 <= weight[live[wide]]
            times.append(time[used])
            places.append(place[used])
            marks.append(point[used])
        t, p, m = np.concatenate(times), np.concatenate(places), np.concatenate(marks)
        last_first = np.argsort(-t, kind="stable")
        flat, filled = np.zeros(n_docs * slots, np.uint64), np.zeros(n_docs * slots, bool)
        flat[p[last_first]], filled[p] = m[last_first], True
        done = open_docs & filled.reshape(n_docs, slots).all(axis=1)
        out[done] = flat.reshape(n_docs, slots)[done]
        open_docs &= ~done
        horizon = horizon * 2
    return out


def bag_signature(hashes: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of one multiset; empty for an empty one."""
    return bag_signatures(np.zeros(len(hashes), np.int64), hashes, counts, 1, slots)[0] if len(hashes) else np.empty(0, np.uint64)


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least counts over sum of greatest counts; 0 where both are empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    common = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def _sign(batches):
    only()
    bands = SLOTS // ROWS
    for pdf in batches:
        for i in range(0, len(pdf), 128):
            part = pdf.iloc[i : i + 128]
            sets = [multiset(t) for t in part["text"]]
            some = [j for j, (h, _) in enumerate(sets) if len(h)]
            keys = [[] for _ in sets]
            if some:
                doc = np.repeat(np.arange(len(some)), [len(sets[j][0]) for j in some])
                sig = bag_signatures(doc, np.concatenate([sets[j][0] for j in some]), np.concatenate([sets[j][1] for j in some]), len(some))
                k = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(some), 1))
                for row in np.moveaxis(sig.reshape(len(some), bands, ROWS), 2, 0):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) ^ row)
                for j, x in zip(some, k.view(np.int64).tolist(), strict=True):
                    keys[j] = x
            yield pd.DataFrame({"doc": part["doc"].to_numpy(), "text_key": part["text_key"].to_numpy(), "bands": keys})
    give_back()


def _parts(batches):
    """The multiset of a text as a set: a hash for each shingle and each of its repeats."""
    only()
    for pdf in batches:
        parts = []
        for text in pdf["text"]:
            h, k = multiset(text)
            nth = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            parts.append(mix(np.repeat(h, k) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist())
        yield pd.DataFrame({"rep": pdf["rep"], "part": parts})
    give_back()


def _block(least: float):
    """Links between members of two blocks of a set of texts (or inside one) that are in different groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root, rep, side = (pdf[c].to_numpy() for c in ("root", "rep", "side"))
        if (root == root[0]).all():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        n = pdf["part"].map(len).to_numpy()
        doc = np.repeat(np.arange(len(n)), n)
        _, column, times = np.unique(np.concatenate(pdf["part"].to_list()), return_inverse=True, return_counts=True)
        several = times > 1  # a part that one text has alone is in no overlap
        place = np.cumsum(several) - 1
        keep = several[column]
        doc, column = doc[keep], place[column[keep]]
        common = np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        for at in range(0, int(several.sum()), 8192):
            lo, hi = np.searchsorted(column, [at, at + 8192])
            m = np.zeros((len(n), 8192), np.float32)
            m[doc[lo:hi], column[lo:hi] - at] = 1
            common += m @ m.T
            del m
        near = (common >= least * (n[:, None] + n[None, :] - common) - 1e-3) & (root[:, None] != root[None, :])
        near &= (side[:, None] < 0) | (side[:, None] != side[None, :])  # inside one block all pairs count, else those across
        del common
        # links that join what is apart: at most one less than there are members
        group, links = root.copy(), []
        for a, b in np.argwhere(np.triu(near, 1)):
            if group[a] != group[b]:
                links.append((max(rep[a], rep[b]), min(rep[a], rep[b])))
                group[group == group[a]] = group[b]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def sets_to_compare(rest: DataFrame) -> DataFrame:
    """(set, rep, root): sets of texts that hold every pair of texts of different groups with a common band.

    rest: band, rep, root.  The texts that bands tie together are a family.  A family is
    one set, or each of its bands is, whichever moves fewer rows: large groups share most
    of their bands, while texts that only a common passage ties in a chain do not.
    """
    n = rest.count()
    by_root = rest.groupBy("band", "root").agg(F.count("*").alias("k"), F.min("rep").alias("lead"))
    bands = by_root.groupBy("band").agg(F.sum("k").alias("count"), F.max("k").alias("k"), F.min("lead").alias("lead"))
    tied = join_hot(rest, bands.select("band", "count", "lead"), ["band"], n)
    family = staged(components(tied.select(F.col("rep").alias("a"), F.col("lead").alias("b"))).select(F.col("id").alias("rep"), F.col("root").alias("family")), "families")
    whole = staged(rest.groupBy("rep").agg(F.first("root").alias("root")).join(family, "rep"), "whole")
    moved = lambda all_, same: all_ * (1 + (all_ - same) / BLOCK)
    per_root = whole.groupBy("family", "root").agg(F.count("*").alias("k"))
    cost = per_root.groupBy("family").agg(F.sum("k").alias("count"), F.max("k").alias("k")).select("family", "count", moved(F.col("count"), F.col("k")).alias("as_one"))
    of_bands = bands.join(family.withColumnRenamed("rep", "lead"), "lead").groupBy("family").agg(F.sum(moved(F.col("count"), F.col("k"))).alias("as_bands"))
    choice = staged(cost.join(of_bands, "family").select("family", "count", (F.col("as_bands") < F.col("as_one")).alias("apart")), "choice")
    chosen = staged(join_hot(whole, choice, ["family"], n), "chosen")
    as_one = chosen.where("not apart").select(F.xxhash64(F.lit("family"), "family").alias("set"), "rep", "root")
    apart = rest.join(chosen.where("apart").select("rep"), "rep", "left_semi")
    return as_one.union(apart.select(F.xxhash64(F.lit("band"), "band").alias("set"), "rep", "root"))


def compared_in_blocks(members: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) inside sets of texts, between texts of different groups; each pair that can be near is compared exactly.

    members: set, rep, root; parts: rep, part.  A set is cut by size (a text can only be
    near one of at least `least` times its size, which is in the same or the next class)
    and by whether a text is in the set's largest group, whose members need no comparison
    among themselves.  So a set with one large group and few strangers costs its size
    times the strangers, in blocks that only move the rows they compare.
    """
    sized = staged(members.join(parts.select("rep", F.size("part").alias("n")), "rep"), "sized")
    n = sized.count()
    by_root = sized.groupBy("set", "root").agg(F.count("*").alias("k"))
    largest = by_root.groupBy("set").agg(F.max_by("root", F.struct("k", "root")).alias("large"), F.sum("k").alias("count"))
    size_class = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / float(np.log(1 / least)) + 1e-9).cast("int")
    placed = staged(join_hot(sized, largest, ["set"], n).select("set", "rep", "root", size_class.alias("size"), (F.col("root") == F.col("large")).alias("same")), "members")
    units = placed.groupBy("set", "size", "same").agg(F.count("*").alias("count")).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    x, y = (units.select("set", *(F.col(c).alias(f"{c}_{i}") for c in ("size", "same", "blocks", "count"))) for i in "xy")
    near_size = (F.col("size_y") == F.col("size_x") + 1) | ((F.col("size_y") == F.col("size_x")) & (F.col("same_x") <= F.col("same_y")))
    pairs = staged(x.join(y, "set").where(near_size & ~(F.col("same_x") & F.col("same_y"))), "blocks")  # a set has a few dozen units
    one = (F.col("size_x") == F.col("size_y")) & (F.col("same_x") == F.col("same_y"))
    key = ["set", "size_x", "same_x", "size_y", "same_y"]

    def side(i: str, others: str) -> DataFrame:
        at = pairs if i == "x" else pairs.where(~one)
        at = at.select(*key, "blocks_x", "blocks_y", F.col(f"size_{i}").alias("size"), F.col(f"same_{i}").alias("same"), F.col(f"count_{i}").alias("count"))
        rows = join_hot(placed, at, ["set", "size", "same"], n)
        own = F.pmod(F.xxhash64("rep"), F.col(f"blocks_{i}")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{others}") - 1)))
        first, second = ("own", "other") if i == "x" else ("other", "own")
        i_x, i_y = F.when(one, F.least(first, second)).otherwise(F.col(first)), F.when(one, F.greatest(first, second)).otherwise(F.col(second))
        return rows.select(*key, i_x.alias("i"), i_y.alias("j"), "rep", "root", F.when(one & (i_x == i_y), -1).when(one, (F.col("own") == i_x).cast("int")).otherwise(F.lit(int(i == "x"))).alias("side"))

    dealt = side("x", "y").union(side("y", "x")).join(parts, "rep")
    return dealt.groupBy(*key, "i", "j").applyInPandas(_block(least), "a long, b long")


def _verify(least: float):
    def run(batches):
        only()
        name, kept = None, None
        for pdf in batches:
            ok = []
            for b, text_a, text_b in zip(pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
                if b != name:
                    name, kept = b, multiset(text_b)
                ok.append(overlap(multiset(text_a), kept) >= least)
            yield pdf.loc[ok, ["a", "b"]]
        kept = None
        give_back()

    return run


def distinct_texts(signed: DataFrame) -> DataFrame:
    """(text_key, rep, first, bands) for every distinct text; first: its least id; rep: a number that no other text has, the first where it can be."""
    reps = staged(signed.groupBy("text_key").agg(F.min("doc").alias("first"), F.first("bands").alias("bands")), "reps")
    shared = reps.groupBy("first").agg(F.count("*").alias("n"), F.min("text_key").alias("lead")).where("n > 1")
    if shared.isEmpty():
        return reps.withColumn("rep", F.col("first"))
    # several texts with one least id: all but one take a hash of their text
    n = reps.count()
    for seed in range(8):
        own = F.when(F.col("lead").isNull() | (F.col("lead") == F.col("text_key")), F.col("first")).otherwise(F.xxhash64("text_key", F.lit(seed)))
        numbered = staged(reps.join(shared.select("first", "lead"), "first", "left").select("text_key", "first", "bands", own.alias("rep")), "reps")
        if numbered.select("rep").distinct().count() == n:
            return numbered
    raise ValueError("no numbers without clashes for the texts that share an id")


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its near-duplicate class), kept, text_key (md5 of the text).

    Two texts are near duplicates at a multiset overlap of at least `least` of their
    five-word shingles (lower case, letters and digits); classes are closed over links.
    Equal texts, also empty ones, are one class.  One text of each class is kept, with
    its least id: of the texts of that id in the class, that with the least key.  A null
    text is a class of its own, as is a null doc_id (class_id null); both are kept.
    Different texts of one id are told apart, and each is in its own class; rows with the
    same doc_id and text are kept or not alike; an empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    texts = rows.where("doc is not null and text is not null").withColumn("text_key", F.md5("text"))
    signed = staged(texts.mapInPandas(_sign, "doc long, text_key string, bands array<long>"), "signed")

    # equal texts: one representative goes on; the sums are partial, so a hot text is one row per task
    reps = distinct_texts(signed)
    member = reps.select("rep", F.explode("bands").alias("band"))
    hubs = member.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    shared = staged(member.join(hubs, "band"), "shared")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (looked_at.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        near = pairs.join(a, "a").join(b, "b").sortWithinPartitions("b").mapInPandas(_verify(least), "a long, b long")
        return staged(near, "links")

    tried = staged(shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    # the texts of all pairs are picked out once, with a shuffle at every size; later joins and blocks only read these
    ids = tried.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "first", "text_key"), "rep")
    one = texts.hint("merge").join(ids.select(F.col("first").alias("doc"), "text_key", "rep"), ["doc", "text_key"])
    looked_at = staged(one.groupBy("rep").agg(F.first("text").alias("text")), "texts")  # a row that repeats is looked at once
    links = linked(tried)
    roots = components(links)

    # bands whose members are in different groups: sets of texts that hold all pairs with such a band are compared in blocks
    placed = shared.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("lo < hi")
    mixed = mixed.groupBy("n", "who").agg(F.min("band").alias("band"))  # bands with the same members are one set
    rest = staged(placed.join(mixed.select("band"), "band").select("band", "rep", "root"), "rest")
    if not rest.isEmpty():
        parts = staged(looked_at.join(rest.select("rep").distinct(), "rep", "left_semi").mapInPandas(_parts, "rep long, part array<long>"), "parts")
        links = links.union(staged(compared_in_blocks(staged(sets_to_compare(rest), "sets"), parts, least), "links"))
        roots = components(links)
    classed = reps.select("text_key", "first", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    if reps.where("rep <> first").isEmpty():  # the root is the least id of its class
        top = classed.select("text_key", F.struct(F.col("root").alias("first"), F.when(F.col("rep") == F.col("root"), F.col("text_key")).alias("text_key")).alias("m"))
    else:
        edges = classed.select(F.col("root").alias("u"), F.struct("first", "text_key").alias("v"))
        top = with_least(edges, edges, reps.count()).select("v.text_key", "m")
    out = signed.select("doc", "text_key").join(top, "text_key")
    kept = (F.col("doc") == F.col("m.first")) & F.coalesce(F.col("text_key") == F.col("m.text_key"), F.lit(False))
    alone = rows.where("doc is null or text is null").select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(True).alias("kept"), F.md5("text").alias("text_key"))
    return out.select(F.col("doc").alias("doc_id"), F.col("m.first").alias("class_id"), kept.alias("kept"), "text_key").union(alone)


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")
