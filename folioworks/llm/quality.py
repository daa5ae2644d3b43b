"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The statistics of every whole text are computed once.  A Gaussian kernel over the
standardised statistics is approximated by random cosine features; each partition
of labelled rows adds up its share of the normal equations, the sums are solved for
ridge weights, and the raw scores of other labelled rows are binned and made monotone
by pooling adjacent violators.  The calibrated score is a probability of label 1.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, only, staged, table

#: Random features, their seed, kernel width in standardised units, ridge, calibration bins.
FEATURES, SEED, WIDTH, RIDGE, BINS = 256, 20, 4.0, 1.0, 200
#: Labelled rows are dealt to so many tasks; each adds one matrix to the sum.
FIT_TASKS = 32
_WORD = re.compile(r"\w+")
NAMES = ["chars", "words", "word_len", "upper", "letters", "digits", "spaces", "lines", "line_len", "distinct", "top", "top5", "repeat2", "repeat_lines", "stops", "commas", "ends", "bangs", "pipes", "marks", "other", "shouting", "short_words", "long_words", "entropy", "spread"]


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text, in the order of NAMES; all 0 for an empty one."""
    text = text or ""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    found = _WORD.findall(text)
    lower = [w.lower() for w in found]
    k = len(found)
    counts = Counter(lower)
    top = [c for _, c in counts.most_common(5)] or [0]
    chars = Counter(text)
    letters = sum(c for x, c in chars.items() if x.isalpha())
    upper = sum(c for x, c in chars.items() if x.isupper())
    digits = sum(c for x, c in chars.items() if x.isdigit())
    spaces = sum(c for x, c in chars.items() if x.isspace())
    lines = text.split("\n")
    some = Counter(x for x in lines if x.strip())
    pairs = Counter(zip(lower, lower[1:], strict=False))
    p = np.fromiter(counts.values(), float, len(counts)) / max(k, 1)
    q = np.fromiter(chars.values(), float, len(chars)) / n
    lens = np.fromiter(map(len, found), float, k) if k else np.zeros(1)
    known = chars["."] + chars[","] + chars["?"] + chars["!"] + chars["|"] + chars["-"] + chars["'"]
    marks = n - letters - digits - spaces
    return [
        np.log1p(n), np.log1p(k), float(lens.mean()), upper / max(letters, 1), letters / n, digits / n, spaces / n, np.log1p(len(lines)), np.log1p(n / len(lines)),
        len(counts) / max(k, 1), top[0] / max(k, 1), sum(top) / max(k, 1), 1 - len(pairs) / max(k - 1, 1) if k > 1 else 0.0, 1 - len(some) / max(sum(some.values()), 1), sum(c for w, c in counts.items() if len(w) <= 3) / max(k, 1),
        chars[","] / n, (chars["."] + chars["?"]) / n, chars["!"] / n, chars["|"] / n, marks / n, (marks - known) / n, sum(w.isupper() and len(w) > 1 for w in found) / max(k, 1), float((lens <= 2).mean()), float((lens >= 12).mean()),
        float(-(p * np.log(p)).sum()) / np.log1p(max(k, 1)) if k else 0.0, float(-(q * np.log(q)).sum()),
    ]


def with_statistics(rows: DataFrame) -> DataFrame:
    """doc, text_hash, stats for rows of doc, text."""

    def run(batches):
        only()
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "text_hash": pdf["text_hash"], "stats": [[float(x) for x in statistics(t)] for t in pdf["text"]]})
        give_back()

    return rows.withColumn("text_hash", F.xxhash64("text")).mapInPandas(run, "doc long, text_hash long, stats array<double>")


def fold(doc) -> "F.Column":
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit(""))), F.lit(5))


class RandomFeatures:
    """Cosines of random directions: inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, size: int = FEATURES, seed: int = SEED, width: float = WIDTH):
        rng = np.random.default_rng(seed)
        self.mean, self.dev, self.size = mean, dev, size
        self.direction = rng.normal(size=(len(mean), size)) / width
        self.phase = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.dev, -8, 8)
        return np.hstack([np.cos(z @ self.direction + self.phase) * np.sqrt(2 / self.size), np.ones((len(z), 1))])


def pool_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y in weighted squares."""
    blocks: list[list[float]] = []
    for v, k in zip(y, w, strict=True):
        blocks.append([float(v), float(k), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


class QualityModel:
    def __init__(self, features: RandomFeatures, weights: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.features, self.weights, self.x, self.y = features, weights, x, y

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.y)


def fit_quality(labelled: DataFrame) -> QualityModel | None:
    """labelled: doc, stats, y (0 to 1). Rows of fold 4 calibrate, the others fit the weights; None without rows."""
    spark = labelled.sparkSession
    dims = range(len(NAMES))
    rows = labelled.withColumn("part", fold(F.col("doc")))
    fit, held = rows.where("part <> 4"), rows.where("part = 4")
    sums = fit.agg(F.count("*").alias("n"), *(f(F.col("stats")[i]).alias(f"{k}{i}") for i in dims for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not sums["n"]:
        return None
    mean, dev = (np.array([sums[f"{k}{i}"] for i in dims]) for k in "ms")
    features = RandomFeatures(mean, np.maximum(dev, 1e-6))

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for pdf in batches:
            z = features(np.array(pdf["stats"].tolist()))
            total += z.T @ np.hstack([z, pdf["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"i": range(FEATURES + 1), "row": total.tolist()})

    shares = fit.select("stats", "y").repartition(FIT_TASKS).mapInPandas(equations, "i int, row array<double>")
    added = shares.groupBy("i").applyInPandas(lambda k, pdf: pd.DataFrame({"i": [k[0]], "row": [np.sum(pdf["row"].tolist(), axis=0).tolist()]}), "i int, row array<double>")
    system = np.array([r["row"] for r in sorted(added.collect(), key=lambda r: r["i"])])  # FEATURES + 1 rows
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-6
    weights = np.linalg.solve(system[:, :-1] + ridge, system[:, -1])
    model = QualityModel(features, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    raw = F.pandas_udf(lambda s: pd.Series(model.raw(np.array(s.tolist()))), "double")
    scored = held.select(raw("stats").alias("raw"), "y")
    binned = scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + 0.5) * BINS / 2))).alias("b"))
    bins = binned.agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("b").collect()  # BINS rows at most
    if bins:
        # a weak pull to the straight line keeps bins with few rows from 0 and 1
        x, y, n = (np.array([r[k] for r in bins], float) for k in ("x", "y", "n"))
        y = (y * n + np.clip(x, 0, 1)) / (n + 1)
        flat = np.clip(pool_violators(y, n + 1), 0, 1)
        keep = np.r_[True, np.diff(x) > 0]
        model.x, model.y = x[keep], flat[keep]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold), text_hash for every row of docs.

    labels: doc_id, quality (0 or 1). Labels of held-out documents (crc32 of the id as
    text is divisible by 5) are never read; several labels of a document count as their
    mean, null ones not at all.  Scores come from the text alone: equal texts have equal
    scores, null and empty texts that of zero statistics; text_hash tells rows of one id apart.  Without labels every score is
    0.5.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    stats = staged(with_statistics(rows), "stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").cast("double").alias("y")).where("doc is not null and y is not null")
    known = known.where(fold(F.col("doc")) != 0).groupBy("doc").agg(F.avg("y").alias("y"))
    model = fit_quality(staged(stats.join(known, "doc").select("doc", "stats", "y"), "labelled"))
    if model is None:
        score = F.lit(0.5)
    else:
        share = docs.sparkSession.sparkContext.broadcast(model)
        score = F.pandas_udf(lambda s: pd.Series(share.value.score(np.array(s.tolist()))), "double")("stats")
    out = stats.select(F.col("doc").alias("doc_id"), (fold(F.col("doc")) == 0).alias("held_out"), score.alias("score"), "text_hash")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")
