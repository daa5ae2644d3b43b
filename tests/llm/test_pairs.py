"""Near-duplicates, fingerprints, decontamination: brute force on small tables, and the odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from folioworks.llm import decontam, fingerprints, minhash
from folioworks.llm.common import components, shingles, words

DOCS = "doc_id long, text string, class_id string, text_key string"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [a + b + c for a in "bcdfgl" for b in "aeiou" for c in ("n", "st", "rk", "m")]


def jaccard(a, b):
    def grams(t):
        w = words(t)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = grams(a), grams(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def classes_by_force(texts, least=0.8):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= least:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = []
    for k in range(12):
        base = prose(rng, rng.choice([6, 40, 120, 400])).split()
        for e in range(5):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 12])):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    hub = prose(rng, 200).split()
    for e in range(40):  # one large group whose members differ from each other
        w = list(hub)
        w[e * 5] = "changed"
        texts.append(" ".join(w))
    return texts + ["", "", "one", "one", "ab ab ab ab ab ab ab", "ab ab ab ab ab ab ab ab", "!!! ???", prose(rng, 20000)]


def test_classes_equal_brute_force(spark, corpus):
    rows = [(i, t, "x", "y") for i, t in enumerate(corpus)] + [(900, None, "x", "y"), (901, None, "x", "y"), (None, "a b c", "x", "y"), (3, corpus[3], "x", "y")]
    got = [tuple(r)[:3] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(got) == len(rows)
    by = {d: (c, k) for d, c, k in got}
    assert [by[i][0] for i in range(len(corpus))] == classes_by_force(corpus)
    assert by[900] == (900, True) and by[901] == (901, True) and by[None] == (None, True)
    assert all(k == (d == c) for d, (c, k) in by.items() if d is not None)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_large_sets_equal_brute_force(spark, monkeypatch):
    """Sets of many blocks and sizes: a shared passage, a large group of near copies, strangers among them."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(11)
    common = prose(rng, 60)
    texts = [f"{common} {prose(rng, rng.choice([3, 8, 12, 14, 16, 30, 60]))}" for _ in range(150)]
    base = f"{common} {prose(rng, 140)}".split()
    for e in range(120):
        w = list(base)
        w[60 + e] = "other"
        w[199 - e // 2] = f"x{e % 7}"
        texts.append(" ".join(w))
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)).collect()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert [by[i] for i in range(len(texts))] == classes_by_force(texts)


def test_sets_hold_every_pair_with_a_common_band(spark):
    rng = random.Random(13)
    rest = [(b, r, r % 7) for b in range(30) for r in rng.sample(range(b // 10 * 40, b // 10 * 40 + 40), 12)]
    rest += [(1000 + i, r, r) for i in range(300) for r in (5000 + i, 5001 + i)]  # a chain: its bands apart move less than all of it
    sets = {}
    for r in minhash.sets_to_compare(spark.createDataFrame(rest, "band long, rep long, root long")).collect():
        sets.setdefault(r["set"], set()).add((r["rep"], r["root"]))
    held = {tuple(sorted((a[0], b[0]))) for m in sets.values() for a in m for b in m if a[1] != b[1]}
    bands = {}
    for b, rep, root in rest:
        bands.setdefault(b, set()).add((rep, root))
    assert {tuple(sorted((a[0], b[0]))) for m in bands.values() for a in m for b in m if a[1] != b[1]} <= held
    assert max(len(m) for m in sets.values()) <= 40


def test_blocks_link_all_that_is_near(spark, monkeypatch):
    """compared_in_blocks on its own: all texts in one set, each its own group but for one large group."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(12)
    texts = []
    for k in range(14):
        base = prose(rng, rng.choice([6, 10, 40, 44, 50, 100])).split()
        for _ in range(5):
            w = list(base) + prose(rng, rng.choice([0, 1, 3])).split()
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    large = prose(rng, 45).split()
    texts += [" ".join([*large[:43], f"y{i}", *large[44:]]) for i in range(30)]
    n = len(texts)
    members = spark.createDataFrame([(1, i, i if i < n - 30 else n - 30) for i in range(n)], "set long, rep long, root long")
    docs = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    links = minhash.compared_in_blocks(members, docs.mapInPandas(minhash._parts, "rep long, part array<long>"), 0.8)
    same = spark.createDataFrame([(i, n - 30) for i in range(n - 29, n)], "a long, b long")
    root = {r["id"]: r["root"] for r in components(links.union(same)).collect()}
    assert [root.get(i, i) for i in range(n)] == classes_by_force(texts)


def test_different_texts_of_one_id_stay_apart(spark):
    a, b, c = (prose(random.Random(k), 80) for k in (1, 2, 3))
    rows = [(5, a), (5, b), (5, b), (9, a + " more"), (9, c), (7, b), (2, c)]
    got = sorted(tuple(r)[:3] for r in minhash.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)).collect())
    assert got == [(2, 2, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 2, False), (9, 5, False)]


def test_hubs_are_split(spark, monkeypatch):
    from folioworks.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    edges = [(1000 + i, 7) for i in range(400)] + [(5000 + i, 1000 + i) for i in range(200)] + [(3, 5000), (9001, 9000)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 3 for e in edges[:-1] for x in e} | {9000: 9000, 9001: 9000}


def test_signature_is_unbiased_for_multisets():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits, n = 0, 0
    for shift in range(20):
        g = h + np.uint64(shift * 7919)
        x, y = minhash.bag_signature(g[a > 0], a[a > 0]), minhash.bag_signature(g[b > 0], b[b > 0])
        hits, n = hits + int((x == y).sum()), n + len(x)
    assert abs(hits / n - true) < 4 * (true * (1 - true) / n) ** 0.5
    assert minhash.overlap((h[:0], a[:0]), (h, b)) == 0.0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100}


def test_fingerprints(spark, corpus):
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(corpus)] + [(7, None, "x", "y"), (7, None, "x", "y")]
    got = fingerprints.fingerprint_pairs(spark.createDataFrame(rows, DOCS)).collect()
    order = sorted((d, t or "") for d, t, *_ in rows)
    assert sorted((r["doc_id"], r["n_chars"]) for r in got) == sorted((d, len(t)) for d, t in order)
    from hashlib import sha256

    want = {}
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        e = fingerprints.edited(t, after)
        want.setdefault((d, sha256(e.encode()).hexdigest()), []).append((fingerprints.fingerprint(t), fingerprints.fingerprint(e), t, e, after))
    for r in got:
        a, b, t, e, after = want[r["doc_id"], r["edited_sha256"]][0]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a, b)
        assert 0 <= r["near_next"] <= 1 and r["near_edited"] == fingerprints.likeness(a, b)
        x, y = set(shingles(t).tolist()), set(shingles(e).tolist())
        if len(x | y) > 100:
            assert abs(r["near_edited"] - len(x & y) / len(x | y)) < 0.12
    assert fingerprints.fingerprint_pairs(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(5, "abcd efgh", "", "")], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint("a")) == 0.0


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 30).capitalize() + ".") for i in range(5)]
    items += [(5, "The train from Paris to Lyon covers 120 km in 2 hours, and Paris is where it stops for 15 minutes."), (6, None), (7, "two words"), (8, "four plain little words")]
    asked = "Once more: The train from Madrid to Sevilla covers 333 km in 4 hours, and Madrid is where it stops for 15 minutes. End"
    broken = "Once more: The train from Madrid to Sevilla covers 333 km in 4 hours, and Toledo is where it stops for 15 minutes. End"
    docs = [(i, f"{prose(rng, 50)}. {items[i][1]} {prose(rng, 50)}", "", "") for i in range(5)]
    docs += [(10, asked, "", ""), (11, broken, "", ""), (12, prose(rng, 5000), "", ""), (13, None, "", ""), (14, "", "", ""), (None, items[0][1], "", ""), (15, "so four plain little words it is", "", ""), (0, docs[0][1], "", "")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k for k in got if k[0] != 11} == {(i, i) for i in range(5)} | {(10, 5), (15, 8), (None, 0)}
    assert not got[10, 5]["same_values"] and got[1, 1]["same_values"]
    assert (11, 5) not in got
    empty = spark.createDataFrame([], DOCS)
    assert decontam.find_leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_fingerprints_of_few_shingles():
    prints = [fingerprints.fingerprint(f"w{i}") for i in range(200)]
    assert all(len(p) == fingerprints.BINS for p in prints) and len(set(prints)) == 200
    assert max(fingerprints.likeness(a, b) for i, a in enumerate(prints) for b in prints[:i]) < 0.1
    assert all(fingerprints.likeness(p, fingerprints.fingerprint("")) == 0.0 for p in prints)
    assert fingerprints.likeness(fingerprints.fingerprint(None), fingerprints.fingerprint(" ")) == 1.0
    rng = random.Random(9)
    short = [fingerprints.fingerprint(prose(rng, 7)) for _ in range(100)]  # three shingles
    assert max(fingerprints.likeness(a, b) for i, a in enumerate(short) for b in short[:i]) < 0.12


def leaks(spark, docs, items):
    got = decontam.find_leaks(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(docs)], DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r for r in got.collect()}


def test_leaks_without_plain_words_or_in_other_case(spark):
    items = ["How tall is Everest?", "What is 12 + 35 - 7 * 4 / 2?", "Name Berlin", "In 1912 Anna Berg met Carl Dorn and Emil Falk near Graz, then Hugo Iser and Jana Kern left for Linz with 3 kg of 2 kg bags.", "?!"]
    docs = [f"so much before. {t} so much after" for t in items]
    docs += [docs[3].lower(), docs[3].upper(), docs[3].title(), "How tall is Olympus? What is 11 + 35 - 7 * 4 / 2? Name Paris", "0 1 2 0 1 2 0 1 2 0 1 2"]
    got = leaks(spark, docs, items)
    assert set(got) == {(i, i) for i in range(4)} | {(k, 3) for k in (5, 6, 7)}
    assert all(r["same_values"] and r["coverage"] == 1 for r in got.values())


def test_leaks_with_one_inconsistent_slot(spark):
    rng = random.Random(8)
    item = f"They saw Paris as {prose(rng, 30)} and then Paris once more with {prose(rng, 30)}"
    pairs = "The train from Paris to Lyon goes on to the old town of Nancy by way of Dijon and the hills"
    docs = [item.replace("then Paris", "then Toledo"), pairs.replace("Paris", "Metz").replace("Lyon", "Metz").replace("Nancy", "Metz").replace("Dijon", "Metz"), pairs.replace("Paris", "Metz").replace("Nancy", "Brest")]
    got = leaks(spark, docs, [item, pairs])
    assert set(got) == {(0, 0), (2, 1)} and got[0, 0]["windows"] >= 50
    # two texts with one id are compared each with its own values
    two = decontam.find_leaks(spark.createDataFrame([(1, item, "", ""), (1, prose(rng, 9) + ". " + pairs, "", "")], DOCS), spark.createDataFrame([(0, item), (1, pairs)], "item_id long, text string"))
    assert {(r["item_id"], r["coverage"], r["same_values"]) for r in two.collect()} == {(0, 1.0, True), (1, 1.0, True)}


def test_leaks_equal_brute_force_for_plain_text(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if r["text"] in t}
    assert whole and whole <= got and len(got) <= len(whole) + 3
