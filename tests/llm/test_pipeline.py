"""The five stages: the whole run against plain Python, and odd rows for each stage."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from folioworks.llm import language, quality
from folioworks.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, rejected boolean, language string"


def near(a, b):
    """Overlap of five-word multisets of 0.8 or more."""
    (na, x), (nb, y) = a, b
    if min(na, nb) < 0.8 * max(na, nb):
        return False
    return sum((x & y).values()) >= 0.8 * sum((x | y).values())


def grams(text):
    w = words(text)
    g = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return sum(g.values()), g


def test_run_equals_plain_python(spark, sf):
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # the classifiers have brute-force tests of their own; here their answers on each stage's input decide
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    for answers in (lambda d: language.identify_language(d).where("not rejected"), lambda d: quality.score_quality(d, labels).where("predicted = 1")):
        here = docs.where(docs["doc_id"].isin(list(left)))
        left = {r["doc_id"]: left[r["doc_id"]] for r in answers(here).select("doc_id").collect()}
    # one of each class of near duplicates stays, that with the least id
    ids, sets, root = sorted(left), {d: grams(t) for d, t in left.items()}, {d: d for d in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if find(a) != find(b) and near(sets[a], sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    left = {d: left[d] for d in ids if find(d) == d}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {d: t for d, t in left.items() if not any(i in t for i in items)}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in left.items()}
    got = pipeline.run(spark, sf).toPandas()
    assert set(got["doc_id"]) == set(want)
    for d, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[d])
    ends = got.assign(end=got["offset"] + got["length"]).groupby("sequence_id")
    assert (ends["length"].sum() == ends["end"].max()).all() and ends["end"].max().max() <= 2048


@pytest.fixture(scope="module")
def rows(spark, sf):
    """Real documents (id, text) and odd rows: no id, no text, one id with two texts, repeated rows, clashing columns."""
    real = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").orderBy("doc_id").limit(60).collect()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "m", None, "xx") for r in real]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(1)
    shuffled = real[0]["text"].split()
    rng.shuffle(shuffled)
    leak = f"{real[1]['text']} {item}"
    odd = [(None, None), (7000, None), (7001, ""), (7002, "12 34 !!"), (None, leak), (7003, leak), (7003, real[2]["text"] + " once more"), (7004, " ".join(shuffled)), (7004, " ".join(shuffled)), (7004, real[0]["text"]), (7005, "word " * 60000)]
    return out + [(i, t, "en", None, None, "m", True, None) for i, t in odd]


def kept(spark, stage, rows, sf):
    df = stage(spark, spark.createDataFrame(rows, DOCS), sf)
    assert df.columns == pipeline.COLUMNS
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_empty_tables(spark, sf):
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), sf).count() == 0


def test_language_stage_on_odd_rows(spark, rows, sf):
    got, all_ = kept(spark, pipeline.language_stage, rows, sf), Counter(r[:2] for r in rows)
    gone = all_ - got
    assert {(None, None), (7000, None), (7001, ""), (7002, "12 34 !!")} <= set(gone) and not got - all_
    assert got[7004, rows[-2][1]] == 1 and got[rows[-3][0], rows[-3][1]] == 2  # repeated rows stay


def test_quality_stage_on_odd_rows(spark, rows, sf):
    got = kept(spark, pipeline.quality_stage, rows, sf)
    scores = quality.score_quality(spark.createDataFrame(rows, DOCS), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert sum(got.values()) == sum(r["predicted"] for r in scores)
    by_text = {}
    for (_, t), n in (Counter(r[:2] for r in rows)).items():
        by_text.setdefault(t, []).append(n)
    for t in by_text:  # equal texts stay or go alike
        some = [k for k in got if k[1] == t]
        assert len(some) in (0, len({r[0] for r in rows if r[1] == t}))


def test_dedup_stage_on_odd_rows(spark, rows, sf):
    got = kept(spark, pipeline.dedup_stage, rows, sf)
    assert got[None, None] == 1 and got[7000, None] == 1 and got[None, rows[64][1]] == 1  # not compared
    assert got[7004, rows[67][1]] == 1 and (7004, rows[0][1]) not in got  # a repeated row once; a copy of another document not
    assert (7001, "") in got and max(got.values()) == 1


def test_decontamination_stage_on_odd_rows(spark, rows, sf):
    got = kept(spark, pipeline.decontamination_stage, rows, sf)
    leak = rows[64][1]
    assert (None, leak) not in got and (7003, leak) not in got
    assert got[7003, rows[66][1]] == 1 or rows[66][1][:-10] not in dict(got)  # the other text of that id is judged alone
    assert got[None, None] == 1 and got[7000, None] == 1 and got[7004, rows[67][1]] == 2


def test_packing_stage_on_odd_rows(spark, rows, sf):
    got = pipeline.packing_stage(spark, spark.createDataFrame(rows, DOCS), sf).toPandas()
    firsts = got[got["start"] == 0]
    assert len(firsts) == len(rows) and firsts["doc_id"].isna().sum() == 2
    assert got["length"].sum() == firsts["doc_tokens"].sum() and (firsts["doc_tokens"] == 1).sum() >= 3
