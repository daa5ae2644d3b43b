"""Needles in texts, similar authors and titles' words beside plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from compare import differences
from folioworks.functions import bits, helpers
from folioworks.operators import matching, needles

HAY = "doc_id long, field string, hay string"


def in_plain_python(hay, wanted):
    return sorted({(d, f, n) for d, f, t in hay for g, n in wanted if f == g and n and t and n in t})


@pytest.mark.parametrize("sent", [needles.SENT, 0], ids=["sent", "joined"])
def test_needles_equal_brute_force(spark, sent):
    rng = random.Random(8)
    letters = ["a", "b", "ab", " ", "é", "𝒳", "\0", "0", "10.", "/"]
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    hay = [(i, rng.choice("xy"), text(rng.choice([0, 1, 5, 6, 7, 40, 300]))) for i in range(150)] + [(900, "x", None), (3, "x", "again " * 50), (3, "x", "again " * 50)]
    cut = lambda t, k: t[(i := rng.randrange(max(1, len(t) - k + 1))) : i + k]
    wanted = {(rng.choice("xy"), cut(rng.choice(hay[:150])[2], k)) for k in [1, 2, 3, 5, 6, 7, 8, 20, 200] * 12}
    wanted |= {("x", "not there at all"), ("y", "a" * 70), ("x", ""), ("z", "a"), ("x", "ain aga")}
    found = needles.find_needles(spark.createDataFrame(hay, HAY).repartition(3), spark.createDataFrame([*wanted, ("x", None), ("x", "ab")], "field string, needle string"), sent)
    assert sorted(tuple(r) for r in found.collect()) == in_plain_python(hay, wanted | {("x", "ab")})


def test_no_needles_or_no_texts(spark):
    none, one = spark.createDataFrame([], HAY), spark.createDataFrame([(1, "x", "some text")], HAY)
    wanted = spark.createDataFrame([("x", "some text"), ("x", "e")], "field string, needle string")
    assert needles.find_needles(none, wanted).collect() == []
    assert needles.find_needles(one, wanted.limit(0)).collect() == []
    assert len(needles.find_needles(one, wanted).collect()) == 2


def test_anchors_are_the_rarest_runs(spark):
    hay = spark.createDataFrame([(i, "x", "doi 10.1234/" + ("b77" if i == 5 else "a") + " end") for i in range(20)], HAY)
    found = needles.anchors(hay, spark.createDataFrame([("x", "10.1234/b77"), ("x", "10.1234/zz"), ("x", "end")], "field string, needle string")).collect()
    by = {r["needle"]: r["needle"][r["at"] : r["at"] + r["k"]] for r in found}
    assert set(by) == {"10.1234/b77", "end"}  # no text has the runs of the third
    assert "b" in by["10.1234/b77"] and by["end"] == "end"


def test_bit_sets_hold_their_members(spark):
    members = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    found = bits.bit_set(spark.createDataFrame([(int(x),) for x in members], "h long"), 1 << 12)
    assert len(found.words) == 64 and found.has(members.view(np.uint64)).all()
    assert not bits.bit_set(spark.createDataFrame([], "h long")).has(members.view(np.uint64)).any()


def test_similar_authors_equal_brute_force(spark):
    """Ten thousand words and forty authors: the prefix filter loses no pair."""
    rng = random.Random(6)
    parts = ["ko", "va", "len", "ščuk", "in", "ov", "sky", "ab", "rr", "mc", "дон", "ёл", "kin", "z", "ee", "tt"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(2, 6)))
    words = {w for w in (word() for _ in range(40_000)) if len(w) >= 4}
    words = sorted(words)[:10_000]
    authors = [word().capitalize() for _ in range(36)] + ["Kuhn-Lee", "Aaaaa", "  ", "Иванов"]
    got = matching.similar_authors(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(a,) for a in authors], "author string"))
    normal = {a: " ".join("".join(c if c.isalnum() else " " for c in a.lower()).split()) for a in authors}
    matcher, want = SequenceMatcher(), set()
    for w in words:
        matcher.set_seq2(w)
        for a, n in normal.items():
            matcher.set_seq1(n)
            if n and matcher.quick_ratio() >= 0.6 and matcher.ratio() >= 0.6:
                want.add((w, a))
    assert {tuple(r) for r in got.collect()} == want and len(words) == 10_000 and len(want) > 500


def test_a_word_of_all_texts_and_titles_is_cut(spark):
    """One word everywhere: its pairs are dealt evenly, and the scores are those of uncut words."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("everywhere word"), (F.col("id") % 7).cast("string")).alias("text"), F.lit("everywhere.txt").alias("filename"))
    bib = spark.range(50).select(F.col("id").alias("item_pos"), F.concat(F.lit("everywhere study"), F.when(F.col("id") % 5 == 0, " word").otherwise("")).alias("title"))
    feats = matching.features(docs)
    cut, whole = (matching.title_overlap(feats, bib, n) for n in (500, 10**9))
    assert sorted(tuple(r) for r in cut.collect()) == sorted(tuple(r) for r in whole.collect())
    assert cut.count() == 400 * 50


def test_similar_names_equal_the_matcher():
    """Ratios of any pair, of long names, long words, names of one letter and characters of no name."""
    rng = random.Random(2)
    word = lambda n, of="abcdé𝒳": "".join(rng.choice(of) for _ in range(n))
    names = sorted({word(rng.randrange(1, 14)) for _ in range(80)} | {word(n, "abc") for n in (63, 64, 65, 130, 210)} | {"a", "ab" * 32})
    words = sorted({word(rng.randrange(4, 16), "abcdéz") for _ in range(500)} | {word(n, "ab") for n in (60, 70, 120, 199, 200, 260)})
    got = [(int(i), int(j)) for w, n in helpers.Names(names, 0.6).similar(words) for i, j in zip(w, n, strict=True)]
    want = {(i, j) for i, w in enumerate(words) for j, n in enumerate(names) if SequenceMatcher(None, n, w).ratio() >= 0.6}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert not list(helpers.Names([], 0.6).similar(words)) and not list(helpers.Names(names, 0.6).similar([]))


def test_characters_in_common_are_counted_with_repeats():
    """The first bound of the similarity; names of a large alphabet go without it and find the same."""
    rng = random.Random(9)
    word = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    names, words = ([word(rng.randrange(4, 12), "abcdé𝒳") for _ in range(60)] for _ in range(2))
    index = helpers.Names(names, 0.6)
    bags = index._bags(np.hstack([index._repeats(index._rows(w).reshape(1, -1)) for w in words]))
    common = np.bitwise_count(bags[:, :, None] & index.bags[:, None, :]).sum(axis=0)
    assert common.tolist() == [[(Counter(w) & Counter(n)).total() for n in names] for w in words]
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    names = [word(rng.randrange(4, 12), wide) for _ in range(60)] + [wide[i : i + 60] for i in range(0, 300, 60)]
    words = [n[1:] + "x" for n in names] + [n[::2] * 2 for n in names]
    index = helpers.Names(names, 0.6)
    got = {(int(i), int(j)) for w, n in index.similar(words) for i, j in zip(w, n, strict=True)}
    assert len(index.bags) > index.BAGS and got == {(i, j) for i, w in enumerate(words) for j, n in enumerate(names) if SequenceMatcher(None, n, w).ratio() >= 0.6} and len(got) > 60


def test_close_authors_by_sent_names_and_by_blocks(spark):
    docs = spark.createDataFrame([(1, "by Schukim and kuhn-lee"), (1, "again schukim"), (2, "nothing at all"), (3, None), (4, "ivanof petrov ivan")], "doc_id long, text string").withColumn("filename", F.lit("f.txt"))
    authors = spark.createDataFrame([("Schukin",), ("SCHUKIN",), ("Ivanov",), ("Petrova",), ("--",)], "author string")
    sent, blocks = (sorted({tuple(r) for r in matching.close_authors(matching.features(docs), authors, n).collect()}) for n in (matching.NAMES, 0))
    assert sent == blocks == [(1, "SCHUKIN"), (1, "Schukin"), (4, "Ivanov"), (4, "Petrova")]


def test_author_signal_takes_similar_words(spark, tmp_path):
    """The registered query beside its SQL and the matcher, also with words and names of 200 characters, in which the matcher drops common ones."""
    rng = random.Random(8)
    word = lambda n, of="abcdeo": "".join(rng.choice(of) for _ in range(n))
    names = [word(rng.randrange(4, 10)) for _ in range(14)] + [word(n, of) for n, of in ((65, "abc"), (150, "abc"), (210, "abcdefghijklmnopqrstuvwxyz0123456789"), (230, "abcdefghijklmnopqrstuvwxyz0123456789"))]
    near = lambda n: "".join(rng.choice((c, c, c, c, rng.choice("abz"))) for c in n) + word(rng.randrange(3))
    texts = [" ".join([*(word(rng.randrange(1, 12)) for _ in range(6)), near(rng.choice(names)), near(names[i % 4 - 4])]) for i in range(40)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"a b {n} c d e") for i, n in enumerate(names, 1)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    query = matching.QUERIES["author_signal"](spark, str(tmp_path))
    assert differences(query, con, matching.SQL["author_signal"]) == ""
    got = {(r["doc_id"], r["author"]) for r in query.where("score = 0.8").collect()}
    words = {r["doc_id"]: r["norm"].split() for r in matching._feats(spark, str(tmp_path)).collect()}
    alike = {(i, n) for i, ws in words.items() for n in names if any(len(w) >= 4 and SequenceMatcher(None, n, w).ratio() >= 0.6 for w in ws)}
    exact = {(r["doc_id"], r["author"]) for r in query.where("score > 0.8").collect()}
    assert got - {(i, n) for i, n in got if n not in names} == alike - exact and len(alike - exact) > 60


def test_authors_of_a_document_are_brought_together_as_one_row(spark):
    """Best scores over all rows of a document, also of one in several rows or without an id; what is exchanged is a row for each document."""
    ids = [1, 1, 2, None, 3]
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "b", 1.2), (1, "c", 0.9), (2, "a", 1.1), (None, "a", 0.9), (4, "c", 1.0)], "doc_id long, author string, score double")
    close = spark.createDataFrame(list(zip(ids, [[0, 1], [1], [], [0, 2], [2]], strict=True)), "doc_id long, numbers array<int>")
    got = matching.best_of_listed(rows, close, [("a", "a"), ("b", "b"), ("c", "c")])
    want = [(1, "a", 0.8), (1, "b", 1.2), (1, "c", 0.9), (2, "a", 1.1), (None, "a", 0.9), (None, "c", 0.8), (3, "c", 0.8), (4, "c", 1.0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    words = spark.createDataFrame([(1, "abcd abce"), (2, None), (3, "zzzz")], "doc_id long, norm string")
    assert sorted(map(tuple, matching.close_numbers(words, [("Abcd", "abcd"), ("--", ""), ("abcD", "abcd"), ("abxx", "abxx")]).collect())) == [(1, [0, 2]), (2, []), (3, [])]
    assert [tuple(r) for r in matching.close_numbers(words.where("doc_id = 1"), []).collect()] == [(1, [])]


def test_author_signal_is_the_same_by_blocks_of_names(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "by Schukim and kuhn-lee", "schukin.txt"), (2, "again schukim", "f"), (3, None, "f"), (4, "ivanof petrov", "f")], "doc_id long, text string, filename string")
    bib = spark.createDataFrame([(1, ["Schukin", "Kuhn-Lee"]), (2, ["Ivanov", "Petrova", "----"])], "item_pos long, authors array<string>")
    signal = lambda: sorted(map(tuple, matching.author_signal(matching.features(docs), bib).collect()))
    sent = signal()
    monkeypatch.setattr(matching, "listed_authors", lambda *_: None)
    assert signal() == sent == [(1, "Kuhn-Lee", 1.0), (1, "Schukin", 1.2), (2, "Schukin", 0.8), (4, "Ivanov", 0.8), (4, "Petrova", 0.8)]


def test_identifiers_in_words_with_marks_equal_brute_force(spark):
    """DOIs are looked for in words with a slash or digit, years among digits: nothing is lost or made up at their ends, and repeats count once."""
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(["a", "b", "1", "19", "50", "/", "10.", " ", "\n", "\t", "é", "-"]) for _ in range(rng.randrange(60)))
    docs = [(i, text(), f"f{rng.choice(['', '1950'])}{i}.txt") for i in range(150)] + [(900, "A b/1 c", "x"), (901, "plain words only", "1950"), (902, None, "y"), (903, "1 950", "z")]
    items = [(i, d, y) for i, (d, y) in enumerate([("b/1", 1950), ("a b", 19), ("a/", 1901), ("ab", -19), ("\n1", 950), ("1\t", None), ("/", 50), ("É1", 5019), ("b a/1", 1), ("10.1919/ab", 0), ("", 7)])]
    feats = matching.features(spark.createDataFrame(docs, "doc_id long, text string, filename string"))
    bib = spark.createDataFrame([(i, d, y) for i, d, y in items], "item_pos long, doi string, year int")
    pairs = lambda df: sorted((r["doc_id"], r["item_pos"]) for r in df.select("doc_id", "item_pos").collect())
    assert pairs(matching.doi_match(feats, bib)) == sorted((n, i) for n, t, _ in docs for i, d, _ in items if d and d.lower() in (t or "").lower())
    assert pairs(matching.year_match(feats, bib)) == sorted((n, i) for n, t, f in docs for i, _, y in items if y is not None and str(y) in (f if t is None else f"{t}\n{f}"))


def test_long_texts_are_read_in_parts_that_fit_a_cache(spark):
    """Parts were 4 million characters, each with hashes of eight bytes."""
    lines = list(needles._lines(needles.pa.RecordBatch.from_pydict({"field": ["x"] * 40, "hay": ["word " * 10_000] * 40}), "hay"))
    assert max(len(line.codes) for _, _, line in lines) < 200_000 and sum(len(rows) for _, rows, _ in lines) == 40


def test_pairs_of_titles_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", 100)
    feats = spark.createDataFrame([(i, "alpha beta", "") for i in range(60)], "doc_id long, norm string, file_norm string")
    bib = spark.createDataFrame([(i, "Alpha beta gamma") for i in range(20)], "item_pos long, title string")
    got = matching.title_overlap(feats, bib)
    assert got.rdd.getNumPartitions() == 24 and got.count() == 1200
