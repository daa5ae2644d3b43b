"""Datasets saved one after the other: the same as in a database with a unique constraint, on random histories."""

import random
import sqlite3

import pyarrow as pa

from folioworks.operators import tasks
from folioworks.operators.links import linked_groups

BASE = "template string, id long, name string, revision long, snapshot string"


def one_by_one(base, changes):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE d (template, id, name, key, revision, snapshot, PRIMARY KEY (template, id), UNIQUE (template, key))")
    for t, i, n, r, s in base:
        db.execute("INSERT INTO d VALUES (?, ?, ?, ?, ?, ?)", (t, i, n, n.casefold(), r, s))
    refused = []
    for u, t, i, n, r, s in sorted(changes):
        n = (n or "").strip()
        if not 0 < len(n) <= 80:
            refused.append((u, t, i, "bad-name"))
            continue
        try:
            if r is None:
                db.execute("INSERT INTO d VALUES (?, ?, ?, ?, 1, ?)", (t, i, n, n.casefold(), s))
            elif db.execute("UPDATE d SET name = ?, key = ?, revision = ?, snapshot = ? WHERE template = ? AND id = ? AND revision = ?", (n, n.casefold(), r + 1, s, t, i, r)).rowcount != 1:
                refused.append((u, t, i, "other-revision"))
        except sqlite3.IntegrityError:
            refused.append((u, t, i, "name-taken"))
    return sorted(db.execute("SELECT template, id, name, revision, snapshot FROM d")), sorted(refused)


def test_random_histories(spark):
    rng = random.Random(12)
    names = ["A", "a ", "Straße", "STRASSE", "b", "B", "c", "d", "", "x" * 81, None, "Ёж", "ёж"]
    base, changes, u = [], [], 0
    for k in range(30):
        t = f"t{k}"
        base += [(t, i, f"own {i}", rng.randrange(3), "s") for i in range(5)] + [(t, 10, "A", 1, None)]
        for _ in range(40):
            u += 1
            new = rng.random() < 0.25
            i = rng.randrange(10, 16) if new or rng.random() < 0.3 else rng.randrange(6)
            name = rng.choice(names) if rng.random() < 0.6 else f"own {i}"
            changes.append((u, t, i, name, None if new else rng.randrange(4), f"s{u}"))
    rng.shuffle(changes)
    want, refused = one_by_one(base, changes)
    got = tasks.save_datasets(spark.createDataFrame(base, BASE), spark.createDataFrame(changes, "update_id long, " + BASE), 50).collect()
    assert sorted((r["template"], r["id"], r["name"], r["revision"], r["snapshot"]) for r in got if r["reason"] is None) == want
    assert sorted((r["update_id"], r["template"], r["id"], r["reason"]) for r in got if r["reason"]) == refused
    assert {r[3] for r in refused} == {"bad-name", "other-revision", "name-taken"}


def test_a_rename_frees_its_name():
    rows = [(None, "t", 1, "One", 1, "s"), (1, "t", 2, "ONE", None, "s"), (2, "t", 1, "Two", 1, "s"), (3, "t", 2, "one", None, "s"), (4, "t", 1, "TWO", 2, "s")]
    held, refused = tasks.fold_saves(rows)
    assert held == {("t", 1): ["TWO", 3, "s"], ("t", 2): ["one", 1, "s"]} and refused == [(1, "t", 2, "name-taken")]


def test_nothing_to_save(spark):
    empty = spark.createDataFrame([], BASE)
    assert tasks.save_datasets(empty, spark.createDataFrame([], "update_id long, " + BASE)).count() == 0


def test_white_space_of_any_kind_makes_no_other_name(spark):
    base = [("t", i, f"own {i}", 1, "s") for i in range(8)]
    changes = [(i, "t", i, w, 1, "s") for i, w in enumerate(["Ab", "\tAB", "ab ", "\x1fAb", " aB ", "　ab\n", "AB\x85", "ab"])]
    got = tasks.save_datasets(spark.createDataFrame(base, BASE), spark.createDataFrame(changes, "update_id long, " + BASE), 1).collect()
    assert sorted((r["update_id"], r["reason"]) for r in got if r["reason"]) == [(i, "name-taken") for i in range(1, 8)]


def test_groups_of_one_template_go_apart(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + 2 * i, 101 + 2 * i) for i in range(50)]
    roots = {r["node"]: r["root"] for r in linked_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == dict.fromkeys(range(41), 0) | {100 + i: 100 + i - i % 2 for i in range(100)}


def test_datasets_apart_as_one_by_one():
    rng, rows = random.Random(3), []
    for i in range(60):
        rows += [(None, "t", i, f"own {i}", rng.choice([None, 0, 1]), "b")] if rng.random() < 0.7 else []
        rows += [(u, "t", i, rng.choice([f"own {i}", f"OWN {i}", "", "x" * 81]), rng.choice([None, 0, 1, 2, 3]), f"s{u}") for u in range(i * 10, i * 10 + rng.randrange(9))]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()], strict=True)], names=["update_id", "template", "id", "name", "revision", "snapshot"])
    held, refused = tasks.fold_saves(rows)
    stored, at, reason = tasks.fold_apart(table)
    assert {(r["template"], r["id"]): [r["name"], r["revision"], r["snapshot"]] for r in stored.to_pylist()} == held
    assert [(*rows[i][:3], tasks.REASONS[w]) for i, w in zip(at, reason, strict=True)] == refused
