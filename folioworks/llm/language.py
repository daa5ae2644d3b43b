"""Language identification by the nearest of several centroids per language.

Texts are vectors of hashed letter trigrams, weighted by term frequency (square
root) and inverse document frequency and scaled to unit length.  Document frequencies
are counted over all training texts.  A bounded sample of each language's vectors is
clustered by spherical k-means; a text gets the language of the centroid with the
greatest cosine and is rejected where that cosine is far below what nearly all training
texts of about its length reach.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix, table
from .quality import fold, pool_violators

#: Hashed trigrams, centroids of a language, rounds of clustering.
DIMS, CENTROIDS, ROUNDS = 4096, 4, 8
#: About so many documents of each language are clustered, those with the least hashes; a cluster of a smaller share than LEAST_SHARE is dropped.
MOST_LABELLED, LEAST_SHARE = 1500, 0.02
#: Rejected below SLACK times the cosine that all but this share of the training texts of the same length class reach.
SLACK, QUANTILE = 0.5, 0.005
#: Classes of text length (powers of two), steps that cosines are counted in, tasks that add up the counts of all others.
CLASSES, STEPS, SUM_TASKS = 21, 400, 32
#: Bits of a row's hash that decide whether it is in the sample.
HASH_BITS = 52
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Square roots of hashed trigram counts of the lower-case letters, a gap for anything else; None without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    x = np.where(letter, points, 32).astype(np.uint64)
    x = np.concatenate([np.array([32], np.uint64), x, np.array([32], np.uint64)])
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]  # a run of gaps is one
    h = mix(x[:-2] | (x[1:-1] << np.uint64(21)) | (x[2:] << np.uint64(42)))
    return np.sqrt(np.bincount((h % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def size_class(n: pd.Series | np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), CLASSES - 1)


def cluster(v: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means from centres drawn by their distance from those drawn before; clusters of few vectors are dropped."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(v)))]
    far = np.maximum(1 - v @ v[chosen[0]], 0)
    while len(chosen) < min(k, len(v)) and far.sum() > 1e-6:
        chosen.append(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum()).clip(0, len(v) - 1)))
        far = np.minimum(far, np.maximum(1 - v @ v[chosen[-1]], 0))
    centres = v[chosen]
    for last in [False] * rounds + [True]:
        own = (v @ centres.T).argmax(axis=1)
        size = np.bincount(own, minlength=len(centres))
        if last:
            large = size >= max(1, LEAST_SHARE * len(v))
            centres = centres[large] if large.any() else centres
        else:
            centres = np.stack([unit(v[own == i].sum(axis=0)) if size[i] else c for i, c in enumerate(centres)])
    return centres


def summed(vectors: DataFrame) -> np.ndarray:
    """The sum of the column v (arrays of one length) over all rows; the driver gets a row for each of SUM_TASKS tasks."""

    def add(batches):
        total = 0.0
        for pdf in batches:
            for v in pdf["v"]:
                total = total + np.frombuffer(v, "<f8")
        if isinstance(total, np.ndarray):
            yield pd.DataFrame({"v": [total.tobytes()]})

    parts = vectors.repartition(SUM_TASKS).mapInPandas(add, "v binary").collect()
    return np.sum([np.frombuffer(r["v"], "<f8") for r in parts], axis=0) if parts else np.zeros(1)


def floors(seen: np.ndarray) -> np.ndarray:
    """The least cosine to accept by class of length, from counts of cosines (classes by STEPS): a low quantile of each class, made monotone over the classes by weight."""
    n = seen.sum(axis=1)
    some = np.flatnonzero(n)
    low = np.array([(np.searchsorted(np.cumsum(seen[i]), max(1.0, QUANTILE * n[i])) / STEPS) for i in some])
    smooth = pool_violators(low, n[some])
    # a class without training texts takes the floor of the next smaller one that has some, the first ones none
    out = np.zeros(CLASSES)
    for i in range(CLASSES):
        at = np.searchsorted(some, i, side="right") - 1
        out[i] = SLACK * smooth[at] if at >= 0 else 0.0
    return out


class LanguageModel:
    """langs: the language of each row of centres; floor: the least cosine to accept by class of size."""

    def __init__(self, langs: list[str], centres: np.ndarray, idf: np.ndarray, floor: np.ndarray):
        self.langs, self.centres, self.idf, self.floor = langs, centres, idf, floor

    def predict(self, texts) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        texts = list(texts)
        for i in range(0, len(texts), 128):
            part = [trigram_counts(t) for t in texts[i : i + 128]]
            some = [v for v in part if v is not None]
            cos = iter(unit(np.stack(some) * self.idf) @ self.centres.T if some else [])
            for t, v in zip(texts[i : i + 128], part, strict=True):
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                c = next(cos)
                j = int(c.argmax())
                best = float(min(1.0, max(0.0, c[j])))
                langs.append(self.langs[j])
                scores.append(best)
                rejected.append(bool(best < self.floor[size_class(np.array([len(t)]))[0]]))
        return langs, scores, rejected


def sample_bound(n: int, most: int) -> int:
    """Of n distinct rows, those whose hash of HASH_BITS bits is below this are about `most`, whatever n is; all, where n is no more."""
    return min(1 << HASH_BITS, -(-most * (1 << HASH_BITS) // max(n, 1)))


def fit_language(rows: DataFrame, most: int = MOST_LABELLED) -> LanguageModel | None:
    """rows: doc, text, lang. Held-out and unlabelled rows are left out; None if none is left.

    Document frequencies and the floors are counted over all rows that are left, in
    partial sums; only the clustering reads a sample, of distinct rows.
    """
    spark = rows.sparkSession
    known = rows.where("text is not null and lang is not null").where(fold(F.col("doc")) != 0).where(F.col("text").rlike(r"\p{L}"))
    known = known.withColumn("h", F.xxhash64("doc", "text"))
    # the sample is of distinct rows, so its share is of them too: a row that repeats is in or out with all its copies
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}  # a row per language
    if not counts:
        return None

    def frequency(batches):
        df = np.zeros(DIMS + 1)
        for pdf in batches:
            for t in pdf["text"]:
                v = trigram_counts(t)
                if v is not None:
                    df[1:] += v > 0
                    df[0] += 1
        yield pd.DataFrame({"v": [df.tobytes()]})
        give_back()

    df = summed(known.select("text").mapInPandas(frequency, "v binary"))
    if not df[0]:
        return None
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 0.1).astype(np.float32)

    share = spark.createDataFrame([(lang, sample_bound(n, most)) for lang, n in counts.items()], "lang string, below long")
    picked = known.select("lang", "text", "h").join(F.broadcast(share), "lang").where(F.col("h").bitwiseAND((1 << HASH_BITS) - 1) < F.col("below"))
    picked = picked.groupBy("lang", "h").agg(F.first("text").alias("text"))  # rows that repeat count once

    def vectors(batches):
        for pdf in batches:
            v = [trigram_counts(t) for t in pdf["text"]]
            ok = [x is not None for x in v]
            yield pd.DataFrame({"lang": pdf["lang"][ok], "h": pdf["h"][ok], "v": [x.astype("<f2").tobytes() for x in v if x is not None]})

    def centres(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        c = cluster(unit(np.stack([np.frombuffer(v, "<f2").astype(np.float32) for v in pdf["v"]]) * idf))
        return pd.DataFrame({"lang": [key[0]] * len(c), "c": [x.astype("<f4").tobytes() for x in c]})

    sample = picked.mapInPandas(vectors, "lang string, h long, v binary")
    fitted = sample.groupBy("lang").applyInPandas(centres, "lang string, c binary").orderBy("lang", "c").collect()  # CENTROIDS rows a language
    model = LanguageModel([r["lang"] for r in fitted], np.stack([np.frombuffer(r["c"], "<f4") for r in fitted]), idf, np.zeros(CLASSES))
    share_model = spark.sparkContext.broadcast(model)

    def cosines(batches):
        seen = np.zeros((CLASSES, STEPS + 1))
        for pdf in batches:
            _, scores, _ = share_model.value.predict(pdf["text"])
            np.add.at(seen, (size_class(pdf["text"].map(len).to_numpy()), (np.array(scores) * STEPS).astype(int)), 1)
        yield pd.DataFrame({"v": [seen.tobytes()]})
        give_back()

    model.floor = floors(summed(known.select("text").mapInPandas(cosines, "v binary")).reshape(CLASSES, STEPS + 1))
    return model


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with one more column: language, a struct of lang_pred, score, rejected (see identify_language)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit_language(rows))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(text: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = model.value.predict(text) if model.value else (["und"] * len(text), [0.0] * len(text), [True] * len(text))
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    return docs.withColumn("language", judge(F.col(text_col).cast("string")))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected for every row of docs.

    Learned from documents whose crc32 of the id as text is not divisible by 5 and whose
    language is known; repeated rows count as often as they come, but are clustered once.
    A null id has the crc32 of an empty text, so it is held out.  A text that is null or has no letter is `und`, score 0, rejected;
    so is every text if there is nothing to learn from.  Equal texts get equal answers;
    ties go to the language first in order.  An empty table gives an empty result; other
    columns are ignored.
    """
    three = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    judged = with_language(three, "doc", "text", "lang")
    return judged.select(F.col("doc").alias("doc_id"), (fold(F.col("doc")) == 0).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op7_language(spark, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
