"""Ordered exports in parts: the parts of a group, one after another, are the group's lines in order."""

import hashlib
import random

from pyspark.sql import functions as F

from folioworks.operators import parts


def exported(spark, tmp_path, rows, part_bytes, order=("pos",)):
    df = spark.createDataFrame(rows, "name string, pos long, line string").repartition(5)
    manifest = parts.write_parts(df, f"file://{tmp_path}/out", "name", list(order), part_bytes)
    got = (parts.part_files(manifest, f"file://{tmp_path}/out", "name") if rows else manifest).collect()
    named = {(r["name"], r["part"]): r for r in got}
    assert len(named) == len(got)
    return named


def test_parts_hold_all_lines_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [("hot", i, "é" * rng.randrange(30)) for i in range(3000)] + [(f"g{i % 7}", i, f"line {i}") for i in range(200)] + [(None, 1, None), (None, 0, "first"), ("a/b =c", 1, "x"), ("hot", 5, "again")]
    named = exported(spark, tmp_path, rows, 700)
    for group in {r[0] for r in rows}:
        mine = sorted(((p, l or "") for g, p, l in rows if g == group))
        whole = "".join(line + "\n" for _, line in mine).encode()
        here = [named[k] for k in sorted((k for k in named if k[0] == group), key=lambda k: k[1])]
        assert [r["offset"] for r in here] == [sum(x["bytes"] for x in here[:i]) for i in range(len(here))]
        assert sum(r["bytes"] for r in here) == len(whole) and sum(r["lines"] for r in here) == len(mine)
        assert all(r["bytes"] <= 700 + 61 for r in here)
        if group == "hot":
            assert len(here) > 100
        assert [r["sha256"] for r in here] == [hashlib.sha256(whole[r["offset"] : r["offset"] + r["bytes"]]).hexdigest() for r in here]


def test_no_range_is_large(spark, tmp_path):
    """Two hundred thousand lines of one group: no task of the last stage holds more than a part."""
    df = spark.range(200_000).select(F.lit("one").alias("name"), F.col("id").alias("pos"), F.format_string("line %07d", "id").alias("line"))
    manifest = parts.write_parts(df, f"file://{tmp_path}/big", "name", ["pos"], 100_000).collect()
    assert sum(r["lines"] for r in manifest) == 200_000 and max(r["bytes"] for r in manifest) <= 100_000 + 13 and len(manifest) == 26


def test_an_empty_table_has_no_part(spark, tmp_path):
    named = exported(spark, tmp_path, [], 100)
    assert named == {}


def test_small_parts_share_files_and_tasks(spark, tmp_path):
    """Two thousand parts of three groups: as many files as groups, no task for each part, and each part's own bytes are hashed; with files of their own, one each."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("name"), F.col("id").alias("pos"), F.format_string("line %07d", "id").alias("line"))
    for file_bytes, files in ((parts.FILE_BYTES, 3), (0, 261)):
        path = tmp_path / f"few{file_bytes}"
        small = df if file_bytes else df.where("pos < 2000")
        got = parts.part_files(parts.write_parts(small, f"file://{path}", "name", ["pos"], 100, file_bytes), f"file://{path}", "name").collect()
        assert len(list(path.rglob("*.txt"))) == files and len(got) == (2601 if file_bytes else 261)
        for r in got:
            if r["part"] % 50 == 0:
                mine = [b"line %07d\n" % i for i in range(r["name"], 20_000 if file_bytes else 2000, 3)]
                at = [i * 13 for i in range(len(mine)) if i * 13 // 100 == r["part"]]
                assert (r["offset"], r["lines"]) == (at[0], len(at)) and r["sha256"] == hashlib.sha256(b"".join(mine[i // 13] for i in at)).hexdigest()
