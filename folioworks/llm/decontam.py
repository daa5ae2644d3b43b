"""Benchmark decontamination by template windows, with DataFrame functions only.

Numbers, names and units of measure become typed placeholders, so a question whose
values were changed keeps its template.  Windows of eight template words of the
benchmark are joined by hash with all windows of the documents.  Windows of literal
words in lower case are a second key in the same join: they find copies whose case
was changed, and items or parts of items with too few plain words for a template,
which are found with their own values only.  A window
with the benchmark's own values always counts.  Windows with other values count where
benchmark and document values map one to one over all such windows of their aligned
run, which ends where a window with a template is missing.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Words in a window, least plain words in one that is also found with other values.
WINDOW, PLAIN = 8, 4
#: An item counts as leaked at this share of its windows, or at so many windows (13 words in a row).
SHARE, MANY = 0.5, 6
#: A side of a join is broadcast up to so many bytes; beyond that both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row of whole numbers in memory, at most.
ROW = 100
#: Words that are a unit after a number.
UNITS = "km cm mm m kg mg g lb lbs oz mi mile miles ft feet inch inches yd yards hour hours hr hrs minute minutes min second seconds sec day days week weeks month months year years dollar dollars euro euros cent cents percent liter liters litre litres ml l degrees mph kmh".split()
NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
LETTERS = r"\p{L}[\p{L}\p{M}]*"


def template_words(text: Column) -> Column:
    """Words of the text in lower case; 0 for a number, 1 for a name (a capitalised word inside a sentence), 2 for a unit."""
    t = F.regexp_replace(text, NUMBER, "0")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},] )\p{Lu}\p{Ll}[\p{L}\p{M}]*", "1")
    t = F.regexp_replace(t, rf"(?<=0 ?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})", "2")
    return F.regexp_extract_all(F.lower(t), F.lit(rf"[012]|{LETTERS}"), 0)


def literal_words(text: Column) -> Column:
    """The words behind template_words, one for one, in lower case; numbers have a # in front, so no word is a placeholder."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, NUMBER, "#$0")), F.lit(rf"#{NUMBER}|{LETTERS}"), 0)


def windows(words: str, size: int) -> Column:
    """Hashes of all runs of `size` words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size))))


def benchmark_index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, words, values, size, n_windows, n_typed) and (h, size, item, at, typed, before) of the items that have words.

    Every window is indexed by its literal words, and those with enough plain words (typed) by their template too;
    before: how many of the item's typed windows come before this one.
    """
    base = items.select(F.col("item_id").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item is not null")
    base = base.select("item", template_words(F.col("text")).alias("words"), literal_words(F.col("text")).alias("values"))
    base = base.where(F.size("words") >= 1).withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    at = base.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    part, literal = F.slice("words", F.col("at"), F.col("size")), F.slice("values", F.col("at"), F.col("size"))
    plain = F.size(F.filter(part, lambda w: ~w.isin("0", "1", "2")))
    at = at.select("item", "size", "at", F.xxhash64(literal).alias("l"), F.xxhash64(part).alias("t"), (plain >= F.least("size", F.lit(PLAIN))).alias("typed"))
    at = at.withColumn("before", F.count_if("typed").over(Window.partitionBy("item").orderBy("at")) - F.col("typed").cast("int"))
    counts = at.groupBy("item").agg(F.count("*").alias("n_windows"), F.count_if("typed").alias("n_typed"))
    keys = F.array_distinct(F.when(F.col("typed"), F.array("l", "t")).otherwise(F.array("l")))
    return base.join(counts, "item"), at.select(F.explode(keys).alias("h"), "size", "item", "at", "typed", "before")


def small_side(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, item_id, windows, item_windows, coverage, same_values, text_hash.

    windows: distinct windows of the item found in aligned runs with consistent values;
    leaked at half of the item's windows, at half of those that have a template, or at
    six.  same_values: no value of a window that counts differs but in case.
    Every position of every whole text is compared.  An item of fewer than eight words
    is one window.  Windows with fewer than four plain words (in shorter items, with any
    other) are found with their own values only, in any case; a copy with both names
    in another case and other values is not found.  Null texts match nothing, nor do
    items without a letter or number or an id; a document without an id is looked at
    like any other.  Equal texts leak alike and come once per id; different texts of one
    id are told apart by text_hash (xxhash64 of the text); empty tables give an empty
    result; other columns are ignored.
    """
    base, index = benchmark_index(items)
    base, index = staged(base, "items"), staged(index, "index")
    n_index = ROW * index.count()
    words = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("values", " ")) + ROW * (1 + F.size("words"))
    n_base = base.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    sizes = sorted(r["size"] for r in base.select("size").distinct().collect())  # at most WINDOW values
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("copy", F.xxhash64("text"))
    worded = rows.select("copy", template_words(F.col("text")).alias("words"), literal_words(F.col("text")).alias("values"))
    found = None
    for size in sizes:
        hashed = worded.select("copy", windows("words", size).alias("t"), windows("values", size).alias("l"))
        both = F.concat("t", F.zip_with("t", "l", lambda t, l: F.when(t != l, l)))  # a plain window has one key
        at = hashed.select("copy", F.size("t").alias("n"), F.posexplode(both).alias("pos", "h"))
        keyed = small_side(index.where(F.col("size") == size), n_index)
        hit = at.join(keyed, "h").select("copy", "item", "size", "at", "typed", "before", (F.col("pos") % F.col("n") + 1).alias("place"))
        found = hit if found is None else found.union(hit)
    if found is None:
        return rows.join(items.select(F.col("item_id").alias("item")).limit(0), F.lit(True)).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), *(F.lit(None).cast(k).alias(c) for c, k in (("windows", "long"), ("item_windows", "long"), ("coverage", "double"), ("same_values", "boolean"), ("text_hash", "long"))))
    hits = staged(found.distinct(), "hits")
    # values behind the placeholders, for texts with hits only, each once
    ids = hits.select("copy").distinct()
    hit_texts = rows.join(small_side(ids, ROW * ids.count()), "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text"))
    valued = hit_texts.select("copy", literal_words(F.col("text")).alias("doc_values"))
    both = hits.join(valued, "copy").join(small_side(base.select("item", "words", "values"), n_base), "item")
    theirs, ours = F.slice("values", F.col("at"), F.col("size")), F.slice("doc_values", F.col("place"), F.col("size"))
    typed = F.zip_with(F.zip_with(theirs, ours, lambda a, b: F.struct(a.alias("theirs"), b.alias("ours"))), F.slice("words", F.col("at"), F.col("size")), lambda p, w: F.when(w.isin("0", "1", "2"), p))
    changed = theirs != ours
    line = ["copy", "item", "line"]
    lined = both.select("copy", "item", "at", "typed", "before", (F.col("place") - F.col("at")).alias("line"), changed.alias("changed"), F.when(changed, F.filter(typed, lambda p: p.isNotNull())).alias("slots"))
    # a run ends where a window that has a template is not among the hits
    along = Window.partitionBy(line).orderBy("at")
    cut = F.coalesce(F.col("before") > F.lag(F.col("before") + F.col("typed").cast("int")).over(along), F.lit(False))
    lined = lined.withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(along))
    slots = lined.where("changed").select(*line, "run", F.explode("slots").alias("s")).groupBy(*line, "run").agg(F.collect_set("s").alias("s"))
    pairs, one_side = F.size("s"), [F.size(F.array_distinct(F.col(f"s.{c}"))) for c in ("theirs", "ours")]
    broken = slots.select(*line, "run", ((pairs != one_side[0]) | (pairs != one_side[1])).alias("clash"))
    good = lined.select(*line, "run", "at", "typed", "changed").join(broken, [*line, "run"], "left").where(~F.col("changed") | ~F.coalesce("clash", F.lit(False)))
    summed = good.groupBy("copy", "item", "at", "typed").agg(F.min("changed").alias("changed"))
    summed = summed.groupBy("copy", "item").agg(F.count("*").alias("windows"), F.count_if("typed").alias("typed"), (~F.max("changed")).alias("same_values"))
    out = summed.join(small_side(base.select("item", "n_windows", "n_typed"), n_index), "item")
    share = (F.col("windows") >= SHARE * F.col("n_windows")) | ((F.col("typed") > 0) & (F.col("typed") >= SHARE * F.col("n_typed")))
    out = staged(out.where(share | (F.col("windows") >= MANY)), "leaks")
    of = rows.select("doc", "copy").join(small_side(out, ROW * out.count()), "copy").groupBy("doc", "copy", "item").agg(*(F.first(c).alias(c) for c in ("windows", "n_windows", "same_values")))
    return of.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows", F.col("n_windows").alias("item_windows"), (F.col("windows") / F.col("n_windows")).alias("coverage"), "same_values", F.col("copy").alias("text_hash"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
