"""Documents to bibliography entries by weighted signals, each found through its own keys instead of all pairs.

A signal is a row (doc_id, item_pos, name, score) with score above 0.  Authors, title
heads, years, DOIs and ISBNs are looked for in all texts in one reading (see needles),
words of titles are joined, so a pair that no signal ties together never exists; its
score would be 0.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import helpers, text as T
from ..plans.inputs import derived, plain
from ..sources.staging import kept
from .needles import find_needles

#: Weight of each kind of signal, least score of a match, of a fuzzy author, length of an empty text and of a title.
WEIGHTS = {"manual": 100.0, "author": 1.0, "title_overlap": 2.0, "title_in_filename": 1.5, "year": 0.15, "doi": 2.0, "isbn": 1.5}
THRESHOLD, FUZZY, EMPTY, TITLE, AUTHORS = 0.30, 0.6, 100, 15, 5
#: Least characters of a word that an author may be similar to; names that are sent to all tasks, words and names in a block.
SHORTEST, NAMES, BLOCK = 4, 2_000, 5_000
#: Pairs that one word may make in one task.
PAIRS = 2_000_000
#: Words (between blanks and line breaks) without a slash or ASCII digit.
UNMARKED = r"(?<![^ \n])[^ \n/0-9]++(?![^ \n])"
#: Fixed value: a title that says there is none.
NO_TITLE = "Unknown"


def features(docs: DataFrame) -> DataFrame:
    """What every signal needs of a document, computed once."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "filename", text.alias("text"), T.normalize_text(text).alias("norm"), T.normalize_text(F.col("filename")).alias("file_norm"),
        (F.length(T.strip(text)) < EMPTY).alias("is_empty"), F.regexp_replace("filename", r"\.[^.]+$", "").alias("stem"),
    )


def hay(feats: DataFrame, *fields: str) -> DataFrame:
    """doc_id, field, hay: the texts that needles are looked for in, a row for each field."""
    low = F.lower("text")
    of = {
        "norm": F.col("norm"), "file": F.col("file_norm"), "under": F.replace("file_norm", F.lit(" "), F.lit("_")), "low": low,
        "marked": F.when(low.rlike("[/0-9]"), F.regexp_replace(low, UNMARKED, " ")), "digits": F.regexp_replace("text", r"(?U)\D", ""), "dated": F.regexp_replace(F.concat_ws("\n", "text", "filename"), "[^-0-9]+", " "),
    }
    return feats.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), of[f].alias("hay")) for f in fields))))


def author_forms(bib: DataFrame) -> DataFrame:
    """author, field, needle, s: how an author may stand in a text (norm) or file name, and what that scores."""
    names = bib.select(F.explode(F.slice("authors", 1, AUTHORS)).alias("author")).where(F.length("author") > 3).distinct()
    plain, latin = T.normalize_text(F.col("author")), T.transliterate(F.col("author"))
    forms = F.array(*(F.struct(F.lit(f).alias("field"), c.alias("needle"), F.lit(s).alias("s")) for f, c, s in (("norm", plain, 1.0), ("norm", latin, 0.9), ("file", plain, 1.2), ("file", latin, 1.1))))
    return names.select("author", F.inline(forms))


def title_heads(bib: DataFrame) -> DataFrame:
    """item_pos, field, needle, latin: a title's first 60 characters, and the whole title in Latin letters."""
    titles, under = bib.where(F.length("title") >= TITLE), lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    heads = titles.select("item_pos", F.lit("under").alias("field"), under(F.substring(T.normalize_text(F.col("title")), 1, 60)).alias("needle"), F.lit(0).alias("latin"))
    return heads.union(titles.where(F.length("title") > TITLE).select("item_pos", F.lit("under"), under(T.transliterate(F.col("title"))), F.lit(1)))


def doi_needles(bib: DataFrame) -> DataFrame:
    """DOIs, in lower case: those of one word with a slash or digit are looked for in such words only, others in whole texts."""
    doi = F.lower("doi")
    return bib.select("item_pos", F.when(doi.rlike("[/0-9]") & ~doi.rlike("[ \\n]"), "marked").otherwise("low").alias("field"), doi.alias("needle"))


def isbn_needles(bib: DataFrame) -> DataFrame:
    return bib.select("item_pos", F.lit("digits").alias("field"), F.regexp_replace("isbn", r"(?U)\D", "").alias("needle"))


def year_needles(bib: DataFrame) -> DataFrame:
    return bib.where("year is not null").select("item_pos", F.lit("dated").alias("field"), F.col("year").cast("string").alias("needle"))


def found_in(feats: DataFrame, *needles: DataFrame) -> DataFrame:
    """(doc_id, field, needle) of all needles that stand in the field that they are looked for in."""
    wanted = reduce(DataFrame.union, [n.select("field", "needle") for n in needles])
    fields = [r["field"] for r in wanted.select("field").distinct().collect()]  # six at most
    return find_needles(hay(feats, *sorted(fields)), wanted) if fields else feats.select("doc_id", F.lit("").alias("field"), F.lit("").alias("needle")).limit(0)


def author_signal(feats: DataFrame, bib: DataFrame, fuzzy: bool = True, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, author, score): 1.2 in the file name, 1.1 there in Latin letters, 1.0 in the text, 0.9 there in Latin letters, else 0.8 for a similar word."""
    forms = author_forms(bib)
    found = found_in(feats, forms) if found is None else found
    rows = found.join(forms, ["field", "needle"]).select("doc_id", "author", F.col("s").alias("score"))
    if fuzzy:
        authors = kept(forms.select("author").distinct(), "names")
        listed = listed_authors(authors)
        if listed is not None:
            return best_of_listed(rows, close_numbers(feats, listed), listed)
        rows = rows.union(close_authors(feats, authors, 0).select("doc_id", "author", F.lit(0.8)))
    return rows.groupBy("doc_id", "author").agg(F.max("score").alias("score"))


def listed_authors(authors: DataFrame, sent: int = NAMES) -> list[tuple[str, str]] | None:
    """(author, normal form) of the authors if there are no more than `sent`."""
    rows = authors.select("author", T.normalize_text(F.col("author")).alias("name")).limit(sent + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= sent else None


def numbered(spark: SparkSession, listed: list[tuple[str, str]]) -> DataFrame:
    """number, author: the authors by their places in the list, for every task."""
    return F.broadcast(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(listed)], "number int, author string"))


def close_numbers(feats: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, numbers): the places of the listed authors to whose normal forms a word of at least four characters is similar; a document stays one row."""
    docs = feats.select("doc_id", "norm")
    return docs.mapInArrow(helpers.similar_names([name for _, name in listed], FUZZY, SHORTEST), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, numbers array<int>")


def best_of_listed(rows: DataFrame, close: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, author, score): the best score of rows (doc_id, author, score), else 0.8 for those of close; a document's authors are brought together as one array."""
    authors = numbered(rows.sparkSession, listed)
    found = rows.join(authors, "author").select("doc_id", F.struct("number", "score").alias("best"), F.lit(None).cast("array<int>").alias("numbers"))
    alike = close.select("doc_id", F.lit(None).cast("struct<number:int,score:double>").alias("best"), "numbers")
    whole = found.union(alike).groupBy("doc_id").agg(F.collect_list("best").alias("best"), F.flatten(F.collect_list("numbers")).alias("numbers"))
    scored = F.sort_array(F.concat("best", F.transform("numbers", lambda n: F.struct(n.alias("number"), F.lit(0.8).alias("score")))))
    last = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["number"] != x["number"], F.lit(True)))
    return whole.select("doc_id", F.inline(T.once(scored, last))).join(authors, "number").select("doc_id", "author", "score")


def close_authors(feats: DataFrame, authors: DataFrame, sent: int = NAMES) -> DataFrame:
    """(doc_id, author) where a word of at least four characters is similar to the author's normal form.

    Up to `sent` authors go to all tasks, which then need no exchange; beyond that, the
    words of all texts meet blocks of names, and documents are joined by word.
    """
    listed = listed_authors(authors, sent)
    if listed is not None:
        close = close_numbers(feats, listed).select("doc_id", F.explode("numbers").alias("number"))
        return close.join(numbered(feats.sparkSession, listed), "number").select("doc_id", "author")
    words = feats.select("doc_id", F.explode(F.array_distinct(F.split("norm", " "))).alias("word")).where(F.length("word") >= SHORTEST)
    return words.join(similar_authors(words.select("word").distinct(), authors), "word").select("doc_id", "author")


def similar_authors(words: DataFrame, authors: DataFrame, in_block: int = BLOCK) -> DataFrame:
    """(word, author): words whose similarity with the author's normal form is at least FUZZY; blocks of words meet blocks of names."""
    names = authors.select("author", T.normalize_text(F.col("author")).alias("name")).where("name <> ''")

    def blocks(df: DataFrame, of: str) -> DataFrame:
        each = kept(df.select(of).distinct(), "block_rows")
        return each.groupBy(F.pmod(F.xxhash64(of), F.lit(-(-each.count() // in_block) or 1)).alias("block")).agg(F.collect_list(of).alias(f"{of}s")).select(f"{of}s")

    alike = blocks(words, "word").crossJoin(blocks(names, "name")).mapInArrow(helpers.similar_blocks(FUZZY), "word string, name string")
    return alike.join(names, "name").select("word", "author")


def title_overlap(feats: DataFrame, bib: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, item_pos, score): share of the title's keywords in the text, or 1.25 times that in the file name.

    A word makes as many pairs as documents times titles that have it.  Words that make
    more than `pairs` (and more than a thousandth of all, so there are at most a thousand
    of them) are cut: their documents are dealt to as many parts as it takes, each of
    which meets all titles with the word.  So no task has much more than `pairs` to count
    for one word, however common it is; every pair is still counted.  There are as many
    tasks as make about PAIRS pairs each.
    """
    titles = bib.where(F.col("title") != NO_TITLE).select("item_pos", T.keywords(T.normalize_text(F.col("title"))).alias("k")).select("item_pos", F.size("k").alias("n"), F.explode("k").alias("word"))
    words = feats.select("doc_id", F.explode(T.keywords(F.col("norm"))).alias("word"), F.lit(1.0).alias("w")).union(feats.select("doc_id", F.explode(T.keywords(F.col("file_norm"))), F.lit(1.25)))
    wanted = titles.groupBy("word").agg(F.count("*").alias("titles"))
    rows = kept(words.join(wanted.select("word"), "word", "left_semi"), "title_words")  # words of no title go before the wide join
    made = kept(rows.groupBy("word").agg(F.count("*").alias("docs")).join(wanted, "word").select("word", (F.col("docs") * F.col("titles")).alias("made")), "word_pairs")
    every = made.agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]
    most = max(pairs, every // 1000)
    heavy = F.broadcast(made.where(F.col("made") > most).select("word", F.ceil(F.col("made") / pairs).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "w"), F.col("parts")).cast("int"), F.lit(0))
    dealt = rows.join(heavy, "word", "left").select("doc_id", "word", "w", part.alias("part"))
    parts = titles.join(heavy, "word", "left").select("item_pos", "n", "word", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"))
    tasks = max(-(-every // PAIRS), int(feats.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.repartition(tasks, "word", "part").join(parts.repartition(tasks, "word", "part"), ["word", "part"])
    by_place = met.repartition(tasks, "doc_id").groupBy("doc_id", "item_pos", "n", "w").agg(F.count("*").alias("k"))  # both counts after one exchange
    return by_place.groupBy("doc_id", "item_pos").agg(F.max(F.col("k") / F.col("n") * F.col("w")).alias("score"))


def title_in_filename(feats: DataFrame, bib: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_pos, name, score): the title's first 60 characters in the file name, else the whole title in Latin letters."""
    heads = title_heads(bib)
    found = found_in(feats, heads) if found is None else found
    least = found.join(heads, ["field", "needle"]).groupBy("doc_id", "item_pos").agg(F.min("latin").alias("latin")).join(feats.select("doc_id", "is_empty"), "doc_id")
    score = F.when(~F.col("is_empty"), 1.0).when(F.col("latin") == 0, 2.0).otherwise(2.5)
    return least.select("doc_id", "item_pos", F.when(F.col("latin") == 0, "title_in_filename").otherwise("title_translit_in_filename").alias("name"), score.alias("score"))


def year_match(feats: DataFrame, bib: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Years of the bibliography that stand in a text or file name, also inside longer numbers."""
    return whole_match(feats, year_needles(bib), found)


def year_for_best(years: DataFrame, bib: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of year_match that can decide a best match: pairs with another signal, and of each year the first item.

    A year alone is the least of all signals, so of the items that have nothing else only
    the first can be a document's best one.  years: (doc_id, field, needle) as found.
    """
    dated = year_needles(bib)
    seen = years.where("field = 'dated'").select("doc_id", "needle")
    first = seen.join(dated.groupBy("needle").agg(F.min("item_pos").alias("item_pos")), "needle").select("doc_id", "item_pos")
    paired = others.select("doc_id", "item_pos").distinct().join(dated.select("item_pos", "needle"), "item_pos").join(seen, ["doc_id", "needle"]).select("doc_id", "item_pos")
    return first.union(paired).distinct().withColumn("score", F.lit(1.0))


def whole_match(feats: DataFrame, needles: DataFrame, found: DataFrame | None) -> DataFrame:
    """(doc_id, item_pos, score) of needles (item_pos, field, needle) that stand in their field."""
    found = found_in(feats, needles) if found is None else found
    return found.join(needles, ["field", "needle"]).select("doc_id", "item_pos").distinct().withColumn("score", F.lit(1.0))


def doi_match(feats: DataFrame, bib: DataFrame, found: DataFrame | None = None) -> DataFrame:
    return whole_match(feats, doi_needles(bib), found)


def isbn_match(feats: DataFrame, bib: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """An ISBN's digits among the digits of a text."""
    return whole_match(feats, isbn_needles(bib), found)


def manual_match(feats: DataFrame, mapping: DataFrame, bib: DataFrame) -> DataFrame:
    """(doc_id, item_pos): file stems that the mapping (stem, item_pos) names; positions that the bibliography lacks are ignored."""
    return feats.select("doc_id", "stem").join(mapping, "stem").join(bib.select("item_pos"), "item_pos", "left_semi").select("doc_id", "item_pos")


def load_manual_matches(defaults: DataFrame, extra: DataFrame) -> DataFrame:
    """(stem, item_pos) of the defaults, overlaid by JSON objects (column json) of stem to position; texts that are no objects count as empty."""
    given = extra.select(F.explode(F.from_json("json", "map<string,bigint>")).alias("stem", "item_pos")).groupBy("stem").agg(F.max("item_pos").alias("item_pos"))
    return defaults.join(given, "stem", "left_anti").select("stem", "item_pos").union(given)


def all_signals(feats: DataFrame, bib: DataFrame, fuzzy: bool = True, weights: dict | None = None, for_best: bool = False) -> DataFrame:
    """Long table doc_id, item_pos, name, score, weight of the signals above 0; for_best leaves out years that cannot decide a best match."""
    w = WEIGHTS | (weights or {})
    # all that is looked for in texts and file names, in one reading
    found = kept(found_in(feats, author_forms(bib), title_heads(bib), doi_needles(bib), isbn_needles(bib), year_needles(bib)), "found")
    authors = author_signal(feats, bib, fuzzy, found).join(bib.select("item_pos", F.explode(F.slice("authors", 1, AUTHORS)).alias("author")), "author")
    parts = [authors.select("doc_id", "item_pos", F.lit("author").alias("name"), "score", F.lit(w["author"]).alias("weight"))]
    parts += [title_in_filename(feats, bib, found).select("doc_id", "item_pos", "name", "score", F.lit(w["title_in_filename"]))]
    parts += [title_overlap(feats, bib).select("doc_id", "item_pos", F.lit("title_overlap"), "score", F.lit(w["title_overlap"]))]
    parts += [f(feats, bib, found).select("doc_id", "item_pos", F.lit(n), "score", F.lit(w[n])) for n, f in (("doi", doi_match), ("isbn", isbn_match))]
    out = reduce(DataFrame.union, parts)
    least = min(v for k, v in w.items() if k != "year")
    if for_best and 0 < w["year"] <= least:  # else a year can outweigh other signals
        out = kept(out, "signals")
        years = year_for_best(found, bib, out)
    else:
        years = year_match(feats, bib, found)
    return out.union(years.select("doc_id", "item_pos", F.lit("year"), "score", F.lit(w["year"])))


def score(signals: DataFrame) -> DataFrame:
    return signals.groupBy("doc_id", "item_pos").agg(F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("score"))


def best_match(docs: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each document with its best item; the first item wins ties, a document without signals has none."""
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("item_pos")).alias("place"))).alias("b"))
    found = docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", (-F.col("b.place")).alias("item_pos"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
    return found.withColumn("matched", (F.col("score") >= threshold) & F.col("item_pos").isNotNull())


def match_files(docs: DataFrame, bib: DataFrame, mapping: DataFrame | None = None, threshold: float = THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """Best match of each document; a manual match wins with the manual weight."""
    feats = kept(features(docs), "features")
    auto = best_match(docs, score(all_signals(feats, bib, fuzzy, for_best=True)), threshold)
    if mapping is None:
        return auto
    manual = manual_match(feats, mapping, bib).select("doc_id", F.col("item_pos").alias("manual"))
    by_hand = F.col("manual").isNotNull()
    return auto.join(manual, "doc_id", "left").select("doc_id", F.coalesce("manual", "item_pos").alias("item_pos"), F.when(by_hand, WEIGHTS["manual"]).otherwise(F.col("score")).alias("score"), (by_hand | F.col("matched")).alias("matched"))


def match_report(matches: DataFrame, signals: DataFrame) -> DataFrame:
    """Of each matched document its item, score and signals in order of name."""
    told = signals.groupBy("doc_id", "item_pos").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%.2f", "name", "score"))), ", ").alias("signals"))
    return matches.where("matched").join(told, ["doc_id", "item_pos"], "left").select("doc_id", "item_pos", F.round("score", 2).alias("score"), F.coalesce("signals", F.lit("manual")).alias("signals"))


def match_preview(matches: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """Present and planned name of each file; unmatched files keep theirs."""
    rows = docs.select("doc_id", "filename").join(matches, "doc_id", "left").join(names, "item_pos", "left")
    return rows.select("doc_id", "filename", F.when(F.col("matched"), F.col("planned")).otherwise(F.col("filename")).alias("new_name"), F.coalesce("matched", F.lit(False)).alias("matched"), F.when(F.col("matched"), F.round("score", 2)).otherwise(0.0).alias("score"))


def match_stats(matches: DataFrame, bib: DataFrame) -> DataFrame:
    """One row: entries, files, matched, unmatched, progress in percent of the entries (100 at most), and how many entries are of each type, by name."""
    m = matches.agg(F.count("*").alias("total_files"), F.count_if("matched").alias("matched_files"))
    types = bib.groupBy("doc_type").agg(F.count("*").alias("n"))  # a row per type
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("doc_type", F.lit("unknown")).alias("t"), "n"))), lambda x: F.concat(x["t"], F.lit("="), x["n"])), ", ")
    b = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_bib"), told.alias("doc_types"))
    progress = F.least(F.lit(100.0), F.coalesce(F.round(F.try_divide(F.col("matched_files") * 100.0, "total_bib"), 1), F.lit(0.0)))
    unmatched = F.greatest(F.lit(0), F.col("total_files") - F.col("matched_files"))
    return m.crossJoin(b).select("total_bib", "total_files", "matched_files", unmatched.alias("unmatched"), progress.alias("progress"), "doc_types")


MBIB = """
SELECT item_id + 1 AS item_pos, CASE WHEN item_id % 17 = 3 THEN 'Unknown' ELSE text END AS title, split_part(text, ' ', 3) || ';' || split_part(text, ' ', 6) || CASE WHEN item_id % 5 = 0 THEN '; Щукин; Kuhn-Lee' ELSE '' END AS authors_text,
  CAST(1950 + item_id % 70 AS STRING) AS year_text, CASE WHEN item_id % 3 = 0 THEN 'book' ELSE 'article' END AS doc_type, CASE WHEN item_id % 19 = 7 THEN '10.1/ab' WHEN item_id % 19 = 8 THEN 'x/Y' ELSE '10.1234/B' || CAST(item_id AS STRING) END AS doi, CASE WHEN item_id % 19 = 5 THEN '123' ELSE '978-5-' || CAST(10000 + item_id AS STRING) || '-1' END AS isbn
FROM {benchmark}
"""
MDOCS = """
SELECT doc_id, d.text || CASE doc_id % 10 WHEN 1 THEN ' published 1955 doi 10.1234/b' || CAST(doc_id % 40 AS STRING) WHEN 2 THEN ' isbn 978-5-' || CAST(10000 + doc_id % 40 AS STRING) || '-1' WHEN 3 THEN ' by Щукин, and Kuhn-Lee' WHEN 4 THEN ' by schukin' WHEN 5 THEN ' see 10.1/AB and x/y in 1123' ELSE '' END AS text,
  CASE doc_id % 6 WHEN 0 THEN replace(substr(coalesce(b.text, 'none'), 1, 60), ' ', '_') WHEN 1 THEN split_part(coalesce(b.text, 'a b none'), ' ', 3) || '_' || CAST(doc_id AS STRING) ELSE 'file_' || CAST(doc_id AS STRING) END || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.TXT' END AS filename
FROM (SELECT doc_id, text FROM {documents} UNION ALL SELECT doc_id + 1000000000, 'short' FROM {documents} WHERE doc_id % 15 = 0) d LEFT JOIN {benchmark} b ON b.item_id = d.doc_id % 40
"""
MANUAL = "SELECT 'file_' || CAST(doc_id AS STRING) AS stem, CAST(1 + quality + toxic * 500 AS BIGINT) AS item_pos FROM {labels}"
EXTRA = "SELECT '{{\"file_' || CAST(doc_id * 2 AS STRING) || '\": ' || CAST(2 + quality AS STRING) || '}}' AS json FROM {labels} UNION ALL SELECT 'not json' FROM {region}"


def _bib(s, d):
    from .corpus import normalize_bib

    return normalize_bib(derived(s, d, MBIB, "benchmark"))


def _docs(s, d):
    return derived(s, d, MDOCS, "documents", "benchmark")


def _manual(s, d):
    return load_manual_matches(derived(s, d, MANUAL, "labels"), derived(s, d, EXTRA, "labels", "region"))


def _feats(s, d):
    return kept(features(_docs(s, d)), "features")


def _matched(s, d, fuzzy=False):
    return match_files(_docs(s, d), _bib(s, d), _manual(s, d), fuzzy=fuzzy)


def _auto(s, d):
    return best_match(_docs(s, d), score(all_signals(_feats(s, d), _bib(s, d), False, for_best=True)))


def _report(s, d):
    signals = kept(all_signals(_feats(s, d), _bib(s, d), False, for_best=True), "signals")
    return match_report(best_match(_docs(s, d), score(signals)), signals.withColumn("score", F.round("score", 6)))


def _names(bib):
    return bib.select("item_pos", F.format_string("%03d_item.pdf", "item_pos").alias("planned"))


_N = lambda e: f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({e})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _translit(e):
    from .corpus import _translit as f

    return f(e)


_WITH = f"""
WITH d AS MATERIALIZED (SELECT *, {_N('text')} AS norm, {_N('filename')} AS fnorm, length(trim(text)) < 100 AS is_empty, regexp_replace(filename, '\\.[^.]+$', '') AS stem, regexp_replace(text, '\\D', '', 'g') AS digits FROM ({plain(MDOCS, 'documents', 'benchmark')})),
b AS MATERIALIZED (SELECT *, list_filter(list_transform(string_split(authors_text, ';'), lambda a: trim(a)), lambda a: a <> '') AS authors, list_distinct(regexp_extract_all({_N('title')}, '{T.KEYWORD}')) AS kw FROM ({plain(MBIB, 'benchmark')})),
au AS MATERIALIZED (SELECT author, {_N('author')} AS a, {_translit('author')} AS la FROM (SELECT DISTINCT unnest(authors[1:5]) AS author FROM b) WHERE length(author) > 3),
sig_author AS MATERIALIZED (SELECT doc_id, author, greatest(CASE WHEN contains(fnorm, a) THEN 1.2 WHEN contains(fnorm, la) THEN 1.1 ELSE 0 END, CASE WHEN contains(norm, a) THEN 1.0 WHEN contains(norm, la) THEN 0.9 ELSE 0 END)::DOUBLE AS score FROM d, au WHERE contains(fnorm, a) OR contains(fnorm, la) OR contains(norm, a) OR contains(norm, la)),
dk AS MATERIALIZED (SELECT doc_id, list_distinct(regexp_extract_all(norm, '{T.KEYWORD}')) AS k, list_distinct(regexp_extract_all(fnorm, '{T.KEYWORD}')) AS fk FROM d),
sig_overlap AS (SELECT doc_id, item_pos, greatest(len(list_intersect(kw, k)) / len(kw)::DOUBLE, 1.25 * len(list_intersect(kw, fk)) / len(kw)::DOUBLE) AS score FROM dk, b WHERE title <> 'Unknown' AND len(kw) > 0 AND (len(list_intersect(kw, k)) > 0 OR len(list_intersect(kw, fk)) > 0)),
sig_file AS (SELECT doc_id, item_pos, CASE WHEN h THEN 'title_in_filename' ELSE 'title_translit_in_filename' END AS name, CASE WHEN NOT is_empty THEN 1.0 WHEN h THEN 2.0 ELSE 2.5 END::DOUBLE AS score FROM (
  SELECT doc_id, item_pos, is_empty, contains(replace(fnorm, ' ', '_'), replace(substr({_N('title')}, 1, 60), ' ', '_')) AS h, length(title) > 15 AND contains(replace(fnorm, ' ', '_'), replace({_translit('title')}, ' ', '_')) AS l FROM d, b WHERE length(title) >= 15) WHERE h OR l),
sig_year AS (SELECT doc_id, item_pos, 1.0::DOUBLE AS score FROM d, b WHERE contains(text, year_text) OR contains(filename, year_text)),
sig_doi AS (SELECT doc_id, item_pos, 1.0::DOUBLE AS score FROM d, b WHERE doi <> '' AND contains(lower(text), lower(doi))),
sig_isbn AS (SELECT doc_id, item_pos, 1.0::DOUBLE AS score FROM d, b WHERE contains(digits, regexp_replace(isbn, '\\D', '', 'g'))),
manual AS (SELECT stem, coalesce(x.item_pos, m.item_pos) AS item_pos FROM ({plain(MANUAL, 'labels')}) m FULL JOIN (SELECT 'file_' || doc_id * 2 AS stem, (2 + quality)::BIGINT AS item_pos FROM labels) x USING (stem)),
sig AS MATERIALIZED (SELECT doc_id, item_pos, 'author' AS name, score, 1.0::DOUBLE AS weight FROM sig_author JOIN (SELECT item_pos, unnest(authors[1:5]) AS author FROM b) USING (author)
  UNION ALL SELECT doc_id, item_pos, name, score, 1.5 FROM sig_file UNION ALL SELECT doc_id, item_pos, 'title_overlap', score, 2.0 FROM sig_overlap UNION ALL SELECT doc_id, item_pos, 'year', score, 0.15 FROM sig_year
  UNION ALL SELECT doc_id, item_pos, 'doi', score, 2.0 FROM sig_doi UNION ALL SELECT doc_id, item_pos, 'isbn', score, 1.5 FROM sig_isbn),
scored AS MATERIALIZED (SELECT doc_id, item_pos, round(sum(score * weight), 6) AS score FROM sig GROUP BY doc_id, item_pos),
auto AS (SELECT d.doc_id, item_pos, coalesce(score, 0.0) AS score, coalesce(score, 0.0) >= 0.3 AND item_pos IS NOT NULL AS matched FROM d LEFT JOIN (SELECT doc_id, item_pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_pos) AS r FROM scored) WHERE r = 1) USING (doc_id)),
hand AS (SELECT doc_id, m.item_pos FROM d JOIN manual m USING (stem) WHERE m.item_pos IN (SELECT item_pos FROM b)),
matches AS MATERIALIZED (SELECT doc_id, coalesce(h.item_pos, a.item_pos) AS item_pos, CASE WHEN h.item_pos IS NOT NULL THEN 100.0 ELSE a.score END AS score, h.item_pos IS NOT NULL OR a.matched AS matched FROM auto a LEFT JOIN hand h USING (doc_id))
"""


def _block(rows: str) -> str:
    """The matching block (i, j, k: its places in x and y, its length) of each row (a, w, m, x, y): the longest run without characters of m, first in x, then in y, and the equal characters around it."""
    longest = lambda n, like: f"coalesce(list_max(list_filter(range(1, {n} + 1), lambda q: {like})), 0)"
    run = f"list_max(list_transform(range(1, length(mx) + 1), lambda p: {{'k': {longest('length(mx) - p + 1', 'contains(my, substr(mx, p, q))')}, 'i': -p}}))"
    before, after = longest("least(i, j) - 1", "substr(x, i - q, q) = substr(y, j - q, q)"), longest("least(length(x) - i - k, length(y) - j - k) + 1", "substr(x, i + k, q) = substr(y, j + k, q)")
    return f"""SELECT a, w, m, x, y, i - e AS i, j - e AS j, k + e + {after} AS k FROM (SELECT *, {before} AS e
    FROM (SELECT *, r.k AS k, CASE WHEN r.k > 0 THEN -r.i ELSE 1 END AS i, CASE WHEN r.k > 0 THEN instr(my, substr(mx, -r.i, r.k)) ELSE 1 END AS j
    FROM (SELECT *, {run} AS r FROM (SELECT *, translate(x, m, repeat(chr(1), length(m))) AS mx, translate(y, m, repeat(chr(2), length(m))) AS my FROM ({rows})))))"""


_RATIO = "2.0::DOUBLE * {} / (length(a) + length(w)) >= 0.6::DOUBLE"
_REPEATS = lambda e: f"length({e}) - length(replace({e}, c, ''))"
#: Similar words by Ratcliff and Obershelp: near bounds the similarity by lengths and characters in common, parts are the matching blocks; m are the characters that the matcher takes no notice of in words from 200 characters on.
_CLOSE = f"""
, words AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT unnest(string_split(norm, ' ')) AS w FROM d) WHERE length(w) >= 4),
near AS MATERIALIZED (SELECT a, w FROM (SELECT DISTINCT a FROM au WHERE a <> ''), words WHERE {_RATIO.format('least(length(a), length(w))')} AND {_RATIO.format(f"list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least({_REPEATS('a')}, {_REPEATS('w')})))")}),
parts AS (
  {_block(f"SELECT a, w, CASE WHEN length(w) < 200 THEN '' ELSE array_to_string(list_filter(list_distinct(string_split(w, '')), lambda c: {_REPEATS('w')} > length(w) // 100 + 1), '') END AS m, a AS x, w AS y FROM near")}
  UNION ALL {_block("SELECT a, w, m, unnest([substr(x, 1, i - 1), substr(x, i + k)]) AS x, unnest([substr(y, 1, j - 1), substr(y, j + k)]) AS y FROM parts WHERE k > 0")} WHERE x <> '' AND y <> ''),
alike AS (SELECT a, w FROM parts GROUP BY a, w HAVING {_RATIO.format('sum(k)')}),
sig_close AS (SELECT doc_id, author, 0.8::DOUBLE AS score FROM (SELECT DISTINCT doc_id, a FROM (SELECT doc_id, unnest(string_split(norm, ' ')) AS w FROM d) JOIN alike USING (w)) JOIN au USING (a))
"""

QUERIES = {
    "author_signal": lambda s, d: author_signal(_feats(s, d), _bib(s, d)),
    "author_signal_fuzzy": lambda s, d: author_signal(_feats(s, d), _bib(s, d)),
    "title_overlap": lambda s, d: title_overlap(_feats(s, d), _bib(s, d)).withColumn("score", F.round("score", 6)),
    "title_in_filename": lambda s, d: title_in_filename(_feats(s, d), _bib(s, d)),
    "year_match": lambda s, d: year_match(_feats(s, d), _bib(s, d)),
    "doi_match": lambda s, d: doi_match(_feats(s, d), _bib(s, d)),
    "isbn_match": lambda s, d: isbn_match(_feats(s, d), _bib(s, d)),
    "manual_matches": _manual,
    "manual_match": lambda s, d: manual_match(_feats(s, d), _manual(s, d), _bib(s, d)),
    "score_signals": lambda s, d: score(all_signals(_feats(s, d), _bib(s, d), False)),
    "best_match": _auto,
    "match_files": _matched,
    "match_files_fuzzy": lambda s, d: _matched(s, d, True),
    "match_report": _report,
    "match_preview": lambda s, d: match_preview(_matched(s, d), _docs(s, d), _names(_bib(s, d))),
    "match_stats": lambda s, d: match_stats(_matched(s, d), _bib(s, d)),
}

SQL = {
    "author_signal": _WITH.replace("WITH", "WITH RECURSIVE", 1) + _CLOSE + "SELECT doc_id, author, max(score) AS score FROM (SELECT * FROM sig_author UNION ALL SELECT * FROM sig_close) GROUP BY doc_id, author",
    "title_overlap": _WITH + "SELECT doc_id, item_pos, round(score, 6) AS score FROM sig_overlap",
    "title_in_filename": _WITH + "SELECT * FROM sig_file",
    "year_match": _WITH + "SELECT * FROM sig_year",
    "doi_match": _WITH + "SELECT * FROM sig_doi",
    "isbn_match": _WITH + "SELECT * FROM sig_isbn",
    "manual_matches": _WITH + "SELECT * FROM manual",
    "manual_match": _WITH + "SELECT * FROM hand",
    "score_signals": _WITH + "SELECT * FROM scored",
    "best_match": _WITH + "SELECT * FROM auto",
    "match_files": _WITH + "SELECT * FROM matches",
    "match_report": _WITH + "SELECT doc_id, item_pos, round(a.score, 2) AS score, string_agg(printf('%s=%.2f', name, round(round(s.score, 6), 2)), ', ' ORDER BY printf('%s=%.2f', name, round(round(s.score, 6), 2))) AS signals FROM auto a JOIN sig s USING (doc_id, item_pos) WHERE matched GROUP BY ALL",
    "match_preview": _WITH + "SELECT doc_id, filename, CASE WHEN matched THEN printf('%03d_item.pdf', item_pos) ELSE filename END AS new_name, matched, CASE WHEN matched THEN round(score, 2) ELSE 0.0 END AS score FROM d JOIN matches USING (doc_id)",
    "match_stats": _WITH + "SELECT *, greatest(0, total_files - matched_files) AS unmatched, least(100.0, round(matched_files * 100.0::DOUBLE / total_bib, 1)) AS progress FROM (SELECT (SELECT count(*) FROM b) AS total_bib, (SELECT string_agg(doc_type || '=' || n, ', ' ORDER BY doc_type) FROM (SELECT doc_type, count(*) AS n FROM b GROUP BY doc_type)) AS doc_types, count(*) AS total_files, count(*) FILTER (matched) AS matched_files FROM matches)",
}
