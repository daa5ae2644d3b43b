"""URL filter: rules on host and path, and for the other URLs the ratio of two character language models.

Both models are Markov models of variable order (0 to 5 characters of context) with
Witten-Bell smoothing: a context that was seen mixes its counts with the next
shorter context, down to an even chance for every character.  One is fitted on all
whole URLs that the rules accept, one on all that they reject; a URL's score is the
difference of its log-likelihoods per character, turned into a probability by a
logistic curve that is fitted on other labelled URLs.
"""

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, staged, table

#: (host, path, verdict): the rules that the query fixes.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
VERDICTS = ("allow", "block")
ORDER = 5
#: The curve is fitted on scores rounded to so many decimals.
PLACES = 3
#: Characters that an even chance is shared between; counts of ends of one and two characters that are sent to all tasks, at most.
ALPHABET, SENT_PARTS = 256, 200_000
_START, _END = "\x02", "\x03"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule (host and path of the longest rule that fits) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def context_counts(urls: DataFrame, key: str = "said") -> DataFrame:
    """(said, gram, n): how often each run of 1 to ORDER + 1 characters ends at a character of a URL; partial sums before the shuffle."""
    text = F.concat(F.lit(_START), "shown", F.lit(_END))
    ends = urls.select(key, text.alias("t")).select(key, "t", F.explode(F.sequence(F.lit(2), F.length("t"))).alias("i"))
    grams = ends.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.least("i", F.lit(ORDER + 1))), lambda k: F.substring("t", F.col("i") - k + 1, k))).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("n"))


def gram_ratios(needed: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio): what each needed gram adds to a score, as UrlScorer.ratio has it, from context_counts' rows."""
    seen = counts.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("said") == v, F.col("n"))), F.lit(0)).alias(v) for v in VERDICTS))
    part = needed.select("gram", F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("k")).withColumn("part", F.expr("right(gram, k)"))
    part = part.withColumn("context", F.expr("left(part, k - 1)"))
    sums = [f(v).alias(f"{name}_{v}") for v in VERDICTS for name, f in (("total", F.sum), ("kinds", lambda v: F.count_if(F.col(v) > 0)))]
    contexts = seen.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(*sums)
    # a row for each character at most: short contexts are in so many grams that they are not dealt out by key
    short, long = F.broadcast(contexts.where("length(context) < 2")), contexts.where("length(context) >= 2")
    known = part.where("k <= 2").join(short, "context").unionByName(part.where("k > 2").join(long, "context"))
    ends = seen.withColumnRenamed("gram", "part")
    few = ends.where("length(part) <= 2")
    few = F.broadcast(few) if few.count() <= SENT_PARTS else few  # the ends of very many grams
    known = known.where("k <= 2").join(few, "part", "left").unionByName(known.where("k > 2").join(ends.where("length(part) > 2"), "part", "left"))
    fields = [f"{name}_{v}" for v in VERDICTS for name in ("total", "kinds")] + list(VERDICTS)
    steps = known.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("steps"))

    def chance(v: str) -> Column:
        def longer(p: Column, e: Column) -> Column:
            return F.when(e[f"total_{v}"] > 0, (F.coalesce(e[v], F.lit(0)) + e[f"kinds_{v}"] * p) / (e[f"total_{v}"] + e[f"kinds_{v}"])).otherwise(p)

        return F.aggregate("steps", F.lit(1.0 / ALPHABET), longer)

    return steps.select("gram", (F.log(chance("allow")) - F.log(chance("block"))).alias("ratio"))


def url_scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(shown, count, x): how often each distinct URL comes and its UrlScorer.score; sums are of decimals, so their order does not matter.

    Grams that very many URLs have, like those they all begin with, are told apart and
    their ratios sent to all tasks.
    """
    t = F.concat(F.lit(_START), "shown", F.lit(_END))
    times = staged(urls.groupBy("shown").agg(F.count("*").alias("count")), "urls")
    ends = times.select("shown", t.alias("t")).select("shown", "t", F.explode(F.sequence(F.lit(2), F.length("t"))).alias("i"))
    first = F.greatest(F.lit(1), F.col("i") - ORDER)
    grams = ends.select("shown", F.substring("t", first, F.col("i") - first + 1).alias("gram"))
    needed = staged(grams.groupBy("gram").agg(F.count("*").alias("count")), "grams")
    ratios = staged(gram_ratios(needed.select("gram"), counts).join(needed, "gram"), "ratios")
    every = needed.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    summed = join_hot(grams, ratios.select("gram", "ratio", "count"), ["gram"], every).groupBy("shown").agg(F.sum(F.col("ratio").cast("decimal(20,12)")).alias("x"))
    return summed.join(times, "shown").select("shown", "count", (F.col("x").cast("double") / (F.length("shown") + 1)).alias("x"))


class MarkovModel:
    """A smoothed model of variable order from gram counts."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        for gram, n in counts.items():
            self.total[gram[:-1]] = self.total.get(gram[:-1], 0) + n
            self.kinds[gram[:-1]] = self.kinds.get(gram[:-1], 0) + 1

    def chance(self, gram: str) -> float:
        """Of the last character after the ones before it."""
        p = 1.0 / ALPHABET
        for k in range(len(gram)):
            context = gram[len(gram) - 1 - k : -1]
            n = self.total.get(context)
            if n is None:
                break
            kinds = self.kinds[context]
            p = (self.counts.get(context + gram[-1], 0) + kinds * p) / (n + kinds)
        return p


class UrlScorer:
    """The difference of both models' log-likelihoods of a URL, per character; the plain form that url_scores is held against."""

    def __init__(self, accepted: dict[str, int], rejected: dict[str, int]):
        self.good, self.bad = MarkovModel(accepted), MarkovModel(rejected)
        self.ratio = lru_cache(200_000)(lambda gram: math.log(self.good.chance(gram)) - math.log(self.bad.chance(gram)))

    def score(self, shown: str) -> float:
        t = _START + shown + _END
        return sum(self.ratio(t[max(0, i - ORDER) : i + 1]) for i in range(1, len(t))) / (len(t) - 1)


def fit_logistic(x: list[float], y: list[int], n: list[int], rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(y = 1) over x, of points that stand for n rows each, by damped Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = a * 1e-3, b * 1e-3, 1e-3, 0.0, 1e-3
        for u, v, m in zip(x, y, n, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * u + b))))
            w = m * p * (1 - p)
            ga, gb = ga + m * (p - v) * u, gb + m * (p - v)
            haa, hab, hbb = haa + w * u * u, hab + w * u, hbb + w
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the probability to be accepted by the models) for every row.

    All rows that a rule decides are the labelled ones: about four in five, by a hash of
    the URL, fit the models and the others the curve.  Models learn and score the whole
    URL with scheme, query and fragment.  Counts, chances and scores stay distributed;
    the driver gets a row for each score rounded to three decimals.  If one verdict has
    no labelled URL there is nothing to compare and undecided URLs are allowed with
    score 0.5.  A null URL is judged as the empty text; one without :// has an empty
    host and path.  Repeated rows count as often as they come and are judged alike, an
    empty table gives an empty result, and other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"))
    judged = with_rule(with_parts(rows), rules).withColumn("shown", F.coalesce("url", F.lit("")))
    known = judged.where("rule_verdict is not null").select(F.col("rule_verdict").alias("said"), "shown")
    counts = staged(context_counts(known.where("pmod(xxhash64(shown), 5) <> 0")), "url-grams")
    if counts.select("said").distinct().count() == len(VERDICTS):
        scores = staged(url_scores(judged, counts), "url-scores")
        n = scores.agg(F.sum("count")).first()[0] or 0
        held = join_hot(known.where("pmod(xxhash64(shown), 5) = 0"), scores.select("shown", "x", "count"), ["shown"], n)
        points = held.groupBy(F.round("x", PLACES).alias("x"), "said").agg(F.count("*").alias("n")).orderBy("x", "said").collect()  # bounded by PLACES
        slope, start = fit_logistic([r["x"] for r in points], [int(r["said"] == "allow") for r in points], [r["n"] for r in points])
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.col("x") + start))
        scored = join_hot(judged, scores.select("shown", "x", "count"), ["shown"], n).withColumn("score", 1 / (1 + F.exp(-z)))
    else:
        scored = judged.withColumn("score", F.lit(0.5))
    by_model = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return scored.select(F.col("page").alias("page_id"), "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
