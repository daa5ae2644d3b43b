"""Packing, binary files, resharding, chat windows, URL rules, classifiers."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioworks.llm import binary, chat, language, packing, quality, reshard, tokens, urls

DOCS = "doc_id long, text string, ids string, grp string"
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", "a", "Ένα. Σίσυφος, ΣΑΣ", "tab\there", "two  spaces \n\n new , line.", "it's 3.14, don't..", "\u00a0nbsp", "e\u0301 İ ŉ", "x,y.z", ".,", "end\n", " lead", "<|endoftext|> </s>", "a\x02b", "漢字 語.", "wo" * 3000]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_ids_equal_the_library(path):
    enc = tokens.WordIds(path, max_words=50)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab,. \n'!1É") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def plain_tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_of_a_column_equal_an_untouched_tokenizer(path):
    plain, marked = plain_tokenizer(path), plain_tokenizer(path)
    marked.encode_special_tokens = True
    rng = random.Random(4)
    pieces = ["a", "The", "don't", "3.5", ",", ".", "...", "\n", "\n\n", "\n\n\n", " ", "  ", "\t", "é", "İ", "Привет", "мир,", "日本語", ").", " .", "~", "a~b", "́", "\xa0", "\u200b", "x²", "\r\n", "'s", "\x03", "Ġ", "</w>", "👍🏽"]
    texts = [None] + ["".join(rng.choice(pieces) + rng.choice(["", " ", ", ", ". "]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    special = ["end <|endoftext|> go", "a<|startoftext|>b"]
    enc = tokens.WordIds(path, max_words=300)  # generations of words come and go
    got = [x.as_py() for part in enc.encode_column(pa.array(texts + special), 2) for x in part]
    for t, ids in zip(texts, got, strict=False):
        assert np.frombuffer(ids, enc.dtype).tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], repr(t)
    # special strings in a text are ordinary text, as stated
    for t, ids in zip(special, got[-2:], strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == [*marked.encode(t, add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(rng.choice([3, 200, 900, 5000]))), "i", "g") for i in range(60)]
    rows += [(100 + i, t, "i", "g") for i, t in enumerate(ODD)] + [(200, None, "i", "g"), (3, rows[3][1], "i", "g"), (None, "null id", "i", "g")]
    return spark.createDataFrame(rows, DOCS), rows


def test_packing(spark, docs):
    df, rows = docs
    got = packing.pack_documents(df, BYTES).toPandas()
    enc = tokens.WordIds(BYTES)
    want = sorted(enc.encode(t or "") + enc.pack([1]) for _, t, *_ in rows)
    seqs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (seqs["length"].sum() <= 2048).all()
    assert (seqs["offset"].first() == 0).all() and (seqs["length"].sum() == (got["offset"] + got["length"]).groupby(got["sequence_id"]).max()).all()
    assert got["length"].sum() == sum(len(w) // 2 for w in want)
    three = [np.concatenate([np.frombuffer(x, "<u4") for x in g.sort_values("start")["ids"]]) for k, g in got.groupby("doc_id") if k != 3]
    assert {x.astype("<u2").tobytes() for x in three} <= set(want)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), BYTES).count() == 0


def test_packing_query_equals_the_library(spark, sf):
    tok = plain_tokenizer(BYTES)
    want = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = packing.op5_packing(spark, sf).toPandas()
    for d, g in got.groupby("doc_id"):
        ids, at = np.array(want.pop(d), "<u4"), 0
        for r in g.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert not want
    ends = got.assign(end=got["offset"] + got["length"]).sort_values("offset").groupby("sequence_id")
    assert (ends["length"].sum() == ends["end"].max()).all() and ends["end"].max().max() <= 2048
    assert got["length"].sum() > 0.9 * 2048 * got["sequence_id"].nunique()


def test_equal_rows_are_packed_in_many_groups(spark):
    df = spark.range(0, 2000, 1, 3).select(F.lit(7).alias("doc_id"), F.lit("the same words " * 20).alias("text"))
    got = packing.pack_documents(df, BYTES).toPandas()
    assert len(got) == 2000 and (got["sequence_id"] // (1 << 32)).value_counts().max() < 700


def test_differencing_covers_every_item_once():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 2048) for _ in range(rng.randint(1, 80))]
        windows = packing.windows_of(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)
    assert sorted(sum(x) for x in [[[4, 5, 6, 7, 8][i] for i in w] for w in packing.difference([4, 5, 6, 7, 8], 2)]) == [14, 16]  # the classic example of differencing


def test_binary_round_trip(spark, docs, tmp_path):
    df, rows = docs
    path = f"file://{tmp_path}/ids"
    manifest = binary.write_ids(df, path, WORDS)
    got = binary.read_ids(manifest, path).collect()
    enc = tokens.WordIds(WORDS)
    want = sorted(((-1 if d is None else d), enc.encode(t or "") + enc.pack([2])) for d, t, *_ in rows)
    at, by_start = 0, sorted(got, key=lambda r: r["start"])
    for (d, ids), r in zip(want, by_start, strict=True):
        plain = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        assert (r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (d, at, len(plain) // 4, plain, zlib.crc32(plain))
        at += r["n_tokens"]
    empty = f"file://{tmp_path}/none"
    assert binary.read_ids(binary.write_ids(spark.createDataFrame([], DOCS), empty, WORDS), empty).count() == 0
    asked = spark.createDataFrame([(3,), (103,), (103,), (None,), (999,)], "doc_id long")
    found = binary.read_documents(manifest, path, asked).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((tuple(r) for r in got if r["doc_id"] in (3, 103, None)), key=repr)


def test_binary_query_equals_the_library(spark, sf, monkeypatch):
    monkeypatch.setattr(binary, "MOST_DOCS", 50)
    tok = plain_tokenizer(WORDS)
    at, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, binary.op8_binary(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_frames_are_separate_and_checked(tmp_path):
    sink = pa.BufferOutputStream()
    w = binary.FrameWriter(sink, 2, frame=64)
    docs = [np.arange(n, dtype="<u2").tobytes() for n in (1, 40, 0, 7, 100, 3)]
    for i, ids in enumerate(docs):
        w.add(i, ids)
    w.finish()
    data = bytearray(sink.getvalue())
    reader = binary.FrameReader(_Source(data))
    assert [reader.ids(i).tobytes() for i in (5, 0, 4, 2, 1, 3)] == [docs[i] for i in (5, 0, 4, 2, 1, 3)]
    assert len(reader.entries) > 2
    one = binary.FrameReader(_Source(data))
    assert [one.row(i, 0)[2] for i in one.find(4)] == [100] and len(one.opened) == 1  # no other frame is decompressed
    assert len(one.find(99)) == 0
    data[reader.starts[1] + 8] ^= 255
    bad = binary.FrameReader(_Source(data))
    assert bad.ids(0).tobytes() == docs[0]
    with pytest.raises(Exception):  # noqa: B017
        [bad.ids(i) for i in range(6)]


class _Source:
    def __init__(self, data):
        self.data = bytes(data)

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_least_cost_flow_moves_only_the_surplus():
    rng = random.Random(7)
    for _ in range(30):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        old = [rng.randint(0, 50) for _ in range(n)]
        new = reshard.even_capacities(sum(old), m)
        flow = reshard.min_cost_flow(old, new)
        assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(n)] == old
        assert [sum(b for (_, j), b in flow.items() if j == k) for k in range(m)] == new
        stay = sum(min(a, b) for a, b in zip(old, new, strict=False))
        assert sum(b for (i, j), b in flow.items() if i != j) == sum(old) - stay
    cost = {(i, j): abs(i - j) ** 2 for i in range(2) for j in range(2)}
    assert reshard.min_cost_flow([3, 1], [1, 3], cost) == {(0, 0): 1, (0, 1): 2, (1, 1): 1}


def test_reshard(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    df, rows = docs
    old = F.when(F.coalesce("doc_id", F.lit(0)) % 3 == 0, 0).otherwise(1)
    got, flow = reshard.reshard(df, old, 3, 4, f"file://{tmp_path}/shards")
    got = got.toPandas()
    assert sorted(map(str, got["text"])) == sorted(str(t) for _, t, *_ in rows)
    sizes = got.assign(size=[len((t or "").encode()) + 16 for t in got["text"]]).groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * max(len(t or "") for _, t, *_ in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    empty, _ = reshard.reshard(spark.createDataFrame([], DOCS), F.lit(0), 1, 4, f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(8)
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "[INST]x[/INST]", "", None, "a\nb", "long " * 900]
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool[/INST]", None]), rng.choice(odd), "x") for c in range(8) for t in range(rng.choice([1, 3, 40]))]
    rows += [(9, 1, "user", "same", "x"), (9, 1, "user", "same", "x"), (None, 0, "assistant", "no conversation", "x"), (9, None, "assistant", "no turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_chats(df, budget=100, history=30)
    read = chat.read_turns(windows).collect()
    plain = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        plain.setdefault(c, []).append((role or "", text or ""))
    for c, turns in plain.items():
        mine = sorted((r for r in read if r["conv_id"] == c), key=lambda r: r["window"])
        assert [(t["role"], t["text"]) for r in mine for t in r["turns"]] == turns
        assert [x for r in mine for x in r["targets"]] == [x for role, x in turns if role == "assistant"]
    for r in windows.collect():
        lead = r["text"].split("</s>")[0]
        if r["conv_id"] is not None and r["conv_id"] % 2 and r["conv_id"] < 8:
            assert lead.startswith("[INST]system[/INST]")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_url_rules(spark):
    cases = [
        ("https://A.org/x?y", "a.org", "/x", "org/", "allow"), ("http://www.example.org/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/1#f", "example.org", "/en/1", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"), ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("a.org/x", "", "", None, None), (None, "", "", None, None), ("x://h?q://z/", "h", "", None, None),
    ]
    rows = [(i, u, "r", "s") for i, (u, *_) in enumerate(cases)] + [(0, cases[0][0], "r", "s")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, score string"), urls.RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    none = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge_urls(none, urls.RULES).collect()] == ["allow"]
    assert urls.judge_urls(none.limit(0), urls.RULES).count() == 0


def test_url_models_learn_whole_urls_of_all_rows(spark):
    rng = random.Random(7)
    rows = [f"http://x.com/{rng.choice(['fr', 'de'])}/{rng.randrange(50)}?k={rng.randrange(9)}" for _ in range(400)] + ["http://x.com/fr/1?k=1"] * 5
    known = [("allow" if "/fr/" in u else "block", u) for u in rows]
    counts = urls.context_counts(spark.createDataFrame(known, "said string, shown string"))
    by = {v: {r["gram"]: r["n"] for r in counts.where(f"said = '{v}'").collect()} for v in ("allow", "block")}
    plain = urls.UrlScorer(by["allow"], by["block"])
    asked = rows[:20] + ["", "no scheme", "ftp://Ελ.net/é?q#漢", "http://x.net/de/1"]
    got = {r["shown"]: r["x"] for r in urls.url_scores(spark.createDataFrame([(u,) for u in asked], "shown string"), counts).collect()}
    assert set(got) == set(asked) and all(abs(got[u] - plain.score(u)) < 1e-9 for u in got)
    # only the query tells these apart
    learn = [f"http://x.com/{'fr' if i % 2 else 'de'}/{i}?{'good' if i % 2 else 'poor'}={i}" for i in range(200)]
    ask = ["http://a.net/q?good=1", "http://a.net/q?poor=1", "good good", "poor poor"]
    judged = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(list(enumerate(ask + learn)), "page_id long, url string"), urls.RULES).collect()}
    assert judged[0]["score"] > judged[1]["score"] and judged[2]["score"] > judged[3]["score"]
    assert len(judged) == len(ask + learn)


def test_markov_chances_sum_to_one_and_tell_apart():
    m = urls.MarkovModel({"a": 3, "b": 1, "aa": 2, "ab": 1})
    left = (urls.ALPHABET - 2) * m.chance("ac")
    assert abs(m.chance("aa") + m.chance("ab") + left - 1) < 1e-9
    assert m.chance("aa") > m.chance("ab") > m.chance("ac")


def test_quality_on_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_quality(docs.withColumn("score", docs["lang"]), labels).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    right = sum(r["predicted"] == known[d] for d, r in got.items() if d in known)
    assert right >= 0.9 * sum(d in known for d in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x y z"), (3, "w " * 50000)], "doc_id long, text string")
    assert quality.score_quality(odd, labels.limit(0)).count() == 5
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def test_isotonic_is_monotone_and_keeps_means():
    y, w = np.array([0.1, 0.9, 0.3, 0.4, 1.0]), np.array([1.0, 1, 3, 1, 1])
    z = quality.pool_violators(y, w)
    assert (np.diff(z) >= 0).all() and abs((z * w).sum() - (y * w).sum()) < 1e-9


def test_language_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in language.identify_language(docs.withColumn("rejected", docs["text"])).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in got if got[d]["held_out"]]
    assert sum(got[d]["lang_pred"] == true[d] for d in held) >= 0.9 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.02 * len(got)
    odd = [(5000, None, "en"), (5001, "", None), (5002, "123 !!", "fr"), (5002, "123 !!", "fr"), (None, "der die das", None)]
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    und = [r for r in language.identify_language(more).collect() if r["doc_id"] is not None and r["doc_id"] >= 5000]
    assert len(und) == 4 and all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in und)
    assert language.identify_language(docs.limit(0)).count() == 0


def test_language_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    model = language.fit_language(docs.select(F.col("doc_id").alias("doc"), "text", "lang"))

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        t = f" {' '.join(letters.split())} "
        out = np.zeros(language.DIMS)
        for i in range(len(t) - 2):
            x = ord(t[i]) | ord(t[i + 1]) << 21 | ord(t[i + 2]) << 42
            out[int(language.mix(np.array([x], np.uint64))[0]) % language.DIMS] += 1
        return np.sqrt(out)

    vectors = {r["doc_id"]: grams(r["text"]) for r in rows}
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] and vectors[r["doc_id"]].any()]
    df = sum((vectors[r["doc_id"]] > 0).astype(int) for r in learned)
    assert np.allclose(model.idf, np.log((1 + len(learned)) / (1 + df)) + 0.1, atol=1e-5)

    def best(v):
        v = v * model.idf
        cos = model.centres @ (v / np.linalg.norm(v))
        return model.langs[int(cos.argmax())], float(cos.max())

    for r in language.identify_language(docs).collect():
        lang, cos = best(vectors[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - cos) < 1e-3
    # the floors rise with length and lie below nearly all cosines of the training texts
    assert (np.diff(model.floor) >= 0).all()
    low = [best(vectors[r["doc_id"]])[1] < model.floor[int(np.log2(len(r["text"])))] for r in learned]
    assert sum(low) <= 0.01 * len(low)


def test_language_samples_of_any_size():
    for n in (1, 1500, 10**6, 1_570_000_000, 10**10, 10**13):
        kept = n * language.sample_bound(n, 1500) / 2**language.HASH_BITS
        assert min(n, 1500) <= kept * 1.000001 <= min(n, 1500) * 1.01
    # one odd text of a rare length does not move the floors of other lengths
    seen = np.zeros((language.CLASSES, language.STEPS + 1))
    seen[8:12, 280] = 1000
    before = language.floors(seen)
    seen[15, 3] = 1
    assert np.allclose(language.floors(seen)[:12], before[:12], atol=0.01)


def test_language_clusters_are_not_single_outliers():
    rng = np.random.default_rng(3)
    v = language.unit(np.abs(np.vstack([np.eye(16)[0] * 3 + rng.random((300, 16)), np.eye(16)[1] * 3 + rng.random((300, 16)), [[0] * 15 + [9]]])).astype(np.float32))
    c = language.cluster(v)
    own = np.bincount((v @ c.T).argmax(axis=1))
    assert len(c) >= 2 and own.min() >= 0.02 * len(v)


def test_language_of_rows_that_repeat(spark, sf):
    """The sample is of distinct rows: one row many times over is still learned, and drives no other language out."""
    text = "The cat sat on the mat and the dog lay on the rug while the rain fell on the roof"
    one = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"))
    got = language.identify_language(one).groupBy("lang_pred", "rejected").count().collect()
    assert [tuple(r) for r in got] == [("en", False, 60_000)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang <> 'en'").select("doc_id", "text", "lang")
    both = language.identify_language(docs.union(one.withColumn("doc_id", F.lit(1_000_001).cast("long"))))
    assert [tuple(r) for r in both.where("doc_id = 1000001").groupBy("lang_pred", "rejected").count().collect()] == [("en", False, 60_000)]


def resharded(spark, docs, n, tmp_path, capacities=None):
    back, flow = reshard.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(n)), n, n, f"file://{tmp_path}/s", capacities)
    rows = back.collect()
    for shard in range(n):
        here = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in here] == list(range(len(here)))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in here]
        assert ids == sorted(ids)
    bytes_ = [sum(len((r["text"] or "").encode()) + 16 for r in rows if r["shard"] == s) for s in range(n)]
    return rows, flow, bytes_


def test_equal_rows_are_dealt_to_all_shards(spark, tmp_path):
    docs = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("one").alias("source"), F.lit("x").alias("shard"), F.lit(1).alias("size"), F.lit(2).alias("h"))
    rows, _, bytes_ = resharded(spark, docs, 4, tmp_path)
    assert len(rows) == 1000 and max(bytes_) - min(bytes_) <= 2 * 29


def test_placement_follows_the_flow(spark, tmp_path):
    """Uneven sources, a hot text, null ids and texts: equal bytes, and hardly more bytes moved than the flow's least."""
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(1, 400), rng.choice(["a", "a", "a", "b", "c"])) for i in range(1500)] + [(7, "hot " * 20, "a")] * 700 + [(None, None, "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    got, flow, bytes_ = resharded(spark, docs, 5, tmp_path)
    docs.unpersist()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((i or -1, t or "") for i, t, _ in rows)
    assert max(bytes_) - min(bytes_) <= 400
    least = sum(b for (i, j), b in flow.items() if i != j)
    moved = sum(len((r["text"] or "").encode()) + 16 for r in got if r["shard"] != r["old_shard"])
    assert moved <= least + 5 * 5 * 416


def test_summed_equations_equal_a_plain_solve(spark):
    """Weights from the sums of many tasks are those of one ridge regression; the features approximate a Gaussian kernel."""
    rng = np.random.default_rng(5)
    stats = rng.normal(size=(300, len(quality.NAMES)))
    y = (stats[:, 0] + 0.3 * stats[:, 1] > 0).astype(float)
    rows = [(i, [float(x) for x in s], float(v)) for i, (s, v) in enumerate(zip(stats, y, strict=True))]
    model = quality.fit_quality(spark.createDataFrame(rows, "doc long, stats array<double>, y double").repartition(7))
    own = np.array([zlib.crc32(str(i).encode()) % 5 != 4 for i in range(300)])
    z = (stats - stats[own].mean(axis=0)) / stats[own].std(axis=0)
    f = np.hstack([np.cos(np.clip(z, -8, 8) @ model.features.direction + model.features.phase) * np.sqrt(2 / quality.FEATURES), np.ones((300, 1))])
    ridge = np.diag([quality.RIDGE] * quality.FEATURES + [1e-6])
    weights = np.linalg.solve(f[own].T @ f[own] + ridge, f[own].T @ y[own])
    assert np.allclose(model.raw(stats), f @ weights, atol=1e-6)
    wide = quality.RandomFeatures(np.zeros(4), np.ones(4), size=20_000, width=2.0)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    kernel = np.exp(-((a - b) ** 2).sum(axis=1) / (2 * 2.0**2))
    assert np.abs((wide(a)[:, :-1] * wide(b)[:, :-1]).sum(axis=1) - kernel).max() < 0.05


def test_curve_lies_where_its_slopes_vanish():
    rng = random.Random(2)
    x = [rng.gauss(0, 1) for _ in range(60)]
    y = [int(rng.random() < 1 / (1 + np.exp(-(2 * v - 0.5)))) for v in x]
    n = [rng.randrange(1, 5) for _ in x]
    a, b = urls.fit_logistic(x, y, n)
    p = 1 / (1 + np.exp(-(a * np.array(x) + b)))
    off = np.array(n) * (p - np.array(y))
    assert abs((off * x).sum() + a * 1e-3) < 1e-5 and abs(off.sum() + b * 1e-3) < 1e-5


def test_hot_urls_and_grams_are_judged_alike(spark, sf, monkeypatch):
    """Keys told apart as hot give the results of those that are not; null URLs and one URL many times among them."""
    from folioworks.llm import common

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    hot = spark.range(300).select((F.col("id") + 10_000).alias("page_id"), F.when(F.col("id") % 2 == 0, "https://a.org/x?q").alias("url"))
    rows = pages.union(hot)
    judged = lambda: sorted(tuple(r) for r in urls.judge_urls(rows, urls.RULES).withColumn("score", F.round("score", 9)).collect())
    plain = judged()
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert judged() == plain and len(plain) == rows.count()
