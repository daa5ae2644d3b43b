"""Records to citations, exports and published files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.inputs import BIB, derived, plain
from ..sources.staging import new_dir
from .corpus import normalize_bib

#: What follows the title in a citation of each type; {} is the field.
PLACES = {"source": "// {}", "year": ". – {}", "pages": ". – {}", "pages_p": ". – {} с.", "doi": ". – DOI: {}", "isbn": ". – ISBN: {}", "degree": ": дис. ... канд. техн. наук. – {}"}
CITATIONS = {
    "article": ["source", "year", "pages", "doi"], "conference": ["source", "year", "pages", "doi"], "book": ["year", "pages_p", "isbn"], "monograph": ["year", "pages_p", "isbn"],
    "dissertation": ["degree", "pages_p"], "abstract": ["year", "pages_p"], "report": ["year"], "patent": ["year"], "standard": ["year"], "collection": ["year"],
}
FIELD = {"pages_p": "pages", "degree": "year"}
NO_AUTHOR = "Без автора"


def _value(name: str) -> Column:
    c = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.when(c != F.lit("0"), c).otherwise("") if name == "year" else c


def _optional(before: str, value: Column, after: str = "") -> Column:
    return F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def gost(kind: Column) -> Column:
    """A citation by type of document; authors and title keep their place when empty, other fields do not."""
    names = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")
    lines = {}
    for t, places in CITATIONS.items():
        tail = [_optional(" " + PLACES[p].split("{}")[0], _value(FIELD.get(p, p)), PLACES[p].split("{}")[1]) for p in places]
        head = F.lit("") if t in ("standard", "collection") else _optional("", names, " ") if t == "patent" else F.concat(names, F.lit(" "))
        lines[t] = F.concat(head, _value("title"), *tail)
    return F.coalesce(*(F.when(kind == t, line) for t, line in lines.items()), lines["article"])


def numbered(bib: DataFrame, by: str = "library", order: str = "item_pos") -> DataFrame:
    return bib.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(order)))


def render_gost(bib: DataFrame) -> DataFrame:
    return numbered(bib).select("library", "item_pos", F.concat("nth", F.lit(". "), gost(F.col("doc_type"))).alias("line"))


def render_bibtex(bib: DataFrame) -> DataFrame:
    title = F.trim(F.replace(F.coalesce(F.nullif(_value("title"), F.lit("")), _value("raw_text")), F.lit("\n"), F.lit(" ")))
    who = F.when(F.size("authors") > 0, F.array_join("authors", " and ")).otherwise("Unknown")
    fields = [F.concat(F.lit("  author = {"), who, F.lit("},\n")), _optional("  title  = {", title, "},\n"), _optional("  year   = {", _value("year"), "},\n"), _optional("  doi    = {", _value("doi"), "},\n"), _optional("  url    = {", _value("url"), "},\n")]
    entry = F.concat(F.format_string("@misc{item%03d,\n", "nth"), *fields, F.lit("}\n"))
    return numbered(bib).select("library", "item_pos", entry.alias("line"))


def bibtex_from_metadata(files: DataFrame) -> DataFrame:
    """Files (filename, title, author, subject) to entries keyed by the stem's letters and digits; in order of filename."""
    from .bibliography import first_year

    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    key = F.regexp_replace(F.substring(stem, 1, 30), "[^a-zA-Z0-9]", "")
    title = F.coalesce(F.nullif(F.trim(_value("title")), F.lit("")), stem)
    year = first_year(F.concat_ws(" ", _value("title"), _value("subject")))
    entry = F.concat(F.lit("@misc{"), F.coalesce(F.nullif(key, F.lit("")), F.lit("ref")), F.lit(",\n"), _optional("  author = {", F.trim(_value("author")), "},\n"), F.lit("  title = {"), title, F.lit("},\n  year = {"), year, F.lit("},\n  note = {PDF}\n}"))
    return files.select("filename", entry.alias("entry")).orderBy("filename")


def render_markdown(bib: DataFrame) -> DataFrame:
    who = F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise(NO_AUTHOR)
    return bib.select("library", "item_pos", F.concat("item_pos", F.lit(". "), who, _optional(" (", _value("year"), ")"), F.lit(". "), _optional("**", _value("title"), "**")).alias("line"))


def render_ris(bib: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a, F.lit("\n"))), "")
    return bib.select("library", "item_pos", F.concat(names, F.lit("TI  - "), _value("title"), F.lit("\nPY  - "), _value("year"), F.lit("\nTY  - "), F.substring(F.upper("doc_type"), 1, 4), F.lit("\nER  -\n")).alias("line"))


def export_library(lines: DataFrame, between: str = "\n") -> DataFrame:
    """One ordered text per library."""
    grouped = lines.groupBy("library").agg(F.array_sort(F.collect_list(F.struct("item_pos", "line"))).alias("l"))
    return grouped.select("library", F.array_join(F.transform("l", lambda e: e["line"]), between).alias("content"))


def export_json(bib: DataFrame, path: str) -> DataFrame:
    """Writes records as JSON lines (raw_text as raw) and returns the lines as read back."""
    fields = [F.col("item_pos").alias("index"), "authors", "title", "year", "doc_type", "source", "pages", "doi", "isbn", "url", F.col("raw_text").alias("raw")]
    bib.select(*fields).write.option("ignoreNullFields", "false").json(path)
    return bib.sparkSession.read.text(path)


def export_csv(bib: DataFrame, path: str) -> DataFrame:
    rows = bib.select(F.col("item_pos").alias("id"), F.array_join("authors", "; ").alias("authors"), "title", F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "doc_type", "source")
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    return bib.sparkSession.read.option("header", True).schema("id long, authors string, title string, year string, doc_type string, source string").csv(path)


def publish(candidates: DataFrame, gates: DataFrame, previous: DataFrame, path: str) -> DataFrame:
    """New output where every gate accepted, else what was there before; written under a new path and read back."""
    passed = gates.groupBy("doc_id").agg(F.bool_and("accepted").alias("accepted"))
    rows = candidates.join(passed, "doc_id", "left").join(previous, "doc_id", "left")
    ok = F.coalesce("accepted", F.lit(False))
    out = rows.select("doc_id", F.when(ok, F.col("new_output")).otherwise(F.col("old_output")).alias("output"), ok.alias("published"))
    out.write.parquet(path)
    return candidates.sparkSession.read.schema(out.schema).parquet(path)


def library(s, d) -> DataFrame:
    return normalize_bib(derived(s, d, BIB, "part")).withColumn("raw_text", F.lit(""))


FILES = "SELECT 'Файл ' || p_name || '-' || CAST(p_partkey AS STRING) || '.pdf' AS filename, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || ' ' || CAST(1990 + p_partkey % 40 AS STRING) END AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_partkey % 2 = 0 THEN 'from 2001' ELSE '' END AS subject FROM {part}"
CANDIDATES = "SELECT doc_id, 'new ' || lang AS new_output FROM {documents}"
GATES = "SELECT doc_id, doc_id % 5 <> 0 AS accepted FROM {documents} UNION ALL SELECT doc_id, doc_id % 7 <> 0 FROM {documents} WHERE doc_id % 2 = 0"
PREVIOUS = "SELECT doc_id, 'old ' || source AS old_output FROM {documents} WHERE doc_id % 3 <> 1"

_B = f"SELECT *, replace(authors_text, '; ', ', ') AS who, coalesce(nullif(year_text, '0'), '') AS yr FROM ({plain(BIB, 'part')})"
_OPT = {"source": "CASE WHEN source <> '' THEN ' // ' || source ELSE '' END", "year": "CASE WHEN yr <> '' THEN ' . – ' || yr ELSE '' END", "pages": "CASE WHEN pages <> '' THEN ' . – ' || pages ELSE '' END", "pages_p": "CASE WHEN pages <> '' THEN ' . – ' || pages || ' с.' ELSE '' END", "doi": "CASE WHEN doi <> '' THEN ' . – DOI: ' || doi ELSE '' END", "isbn": "CASE WHEN isbn <> '' THEN ' . – ISBN: ' || isbn ELSE '' END", "degree": "CASE WHEN yr <> '' THEN ' : дис. ... канд. техн. наук. – ' || yr ELSE '' END"}


def _gost_sql(t: str) -> str:
    head = "" if t in ("standard", "collection") else "CASE WHEN who <> '' THEN who || ' ' ELSE '' END || " if t == "patent" else "who || ' ' || "
    return head + "title || " + " || ".join(_OPT[p] for p in CITATIONS[t])


_GOST = f"SELECT library, item_pos, row_number() OVER (PARTITION BY library ORDER BY item_pos) || '. ' || CASE doc_type {' '.join(f'WHEN {t!r} THEN {_gost_sql(t)}' for t in CITATIONS)} ELSE {_gost_sql('article')} END AS line FROM ({_B})"

QUERIES = {
    "render_gost": lambda s, d: render_gost(library(s, d)),
    "render_bibtex": lambda s, d: render_bibtex(library(s, d)),
    "bibtex_from_metadata": lambda s, d: bibtex_from_metadata(derived(s, d, FILES, "part")),
    "render_markdown": lambda s, d: render_markdown(library(s, d)),
    "render_ris": lambda s, d: render_ris(library(s, d)),
    "export_library": lambda s, d: export_library(render_gost(library(s, d))),
    "export_json": lambda s, d: export_json(library(s, d), new_dir(s, "json")),
    "export_csv": lambda s, d: export_csv(library(s, d), new_dir(s, "csv")).na.fill(""),
    "publish": lambda s, d: publish(derived(s, d, CANDIDATES, "documents"), derived(s, d, GATES, "documents"), derived(s, d, PREVIOUS, "documents"), new_dir(s, "published")),
}

SQL = {
    "render_gost": _GOST,
    "render_bibtex": f"SELECT library, item_pos, '@misc{{item' || lpad(nth::VARCHAR, greatest(3, length(nth::VARCHAR))::INT, '0') || ',' || chr(10) || '  author = {{' || CASE WHEN who = '' THEN 'Unknown' ELSE replace(who, ', ', ' and ') END || '}},' || chr(10) || '  title  = {{' || title || '}},' || chr(10) || CASE WHEN yr <> '' THEN '  year   = {{' || yr || '}},' || chr(10) ELSE '' END || CASE WHEN doi <> '' THEN '  doi    = {{' || doi || '}},' || chr(10) ELSE '' END || CASE WHEN url <> '' THEN '  url    = {{' || url || '}},' || chr(10) ELSE '' END || '}}' || chr(10) AS line FROM (SELECT *, row_number() OVER (PARTITION BY library ORDER BY item_pos) AS nth FROM ({_B}))",
    "bibtex_from_metadata": f"""SELECT filename, '@misc{{' || coalesce(nullif(regexp_replace(substr(stem, 1, 30), '[^a-zA-Z0-9]', '', 'g'), ''), 'ref') || ',' || chr(10) || CASE WHEN author <> '' THEN '  author = {{' || author || '}},' || chr(10) ELSE '' END || '  title = {{' || CASE WHEN trim(title) = '' THEN stem ELSE trim(title) END || '}},' || chr(10) || '  year = {{' || coalesce(nullif(regexp_extract(title || ' ' || subject, '\\b(?:19|20)\\d{{2}}\\b'), ''), 'n.d.') || '}},' || chr(10) || '  note = {{PDF}}' || chr(10) || '}}' AS entry FROM (SELECT *, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM ({plain(FILES, 'part')}))""",
    "render_markdown": f"SELECT library, item_pos, item_pos || '. ' || CASE WHEN who = '' THEN '{NO_AUTHOR}' ELSE who END || CASE WHEN yr <> '' THEN ' (' || yr || ')' ELSE '' END || '. **' || title || '**' AS line FROM ({_B})",
    "render_ris": f"SELECT library, item_pos, CASE WHEN who = '' THEN '' ELSE 'AU  - ' || replace(who, ', ', chr(10) || 'AU  - ') || chr(10) END || 'TI  - ' || title || chr(10) || 'PY  - ' || yr || chr(10) || 'TY  - ' || substr(upper(doc_type), 1, 4) || chr(10) || 'ER  -' || chr(10) AS line FROM ({_B})",
    "export_library": f"SELECT library, string_agg(line, chr(10) ORDER BY item_pos) AS content FROM ({_GOST}) GROUP BY library",
    "export_json": f"SELECT to_json({{'index': item_pos, 'authors': list_filter(string_split(authors_text, '; '), lambda a: a <> ''), 'title': title, 'year': try_cast(nullif(year_text, '') AS INT), 'doc_type': doc_type, 'source': source, 'pages': pages, 'doi': doi, 'isbn': isbn, 'url': url, 'raw': ''}})::VARCHAR AS value FROM ({_B})",
    "export_csv": f"SELECT item_pos AS id, authors_text AS authors, title, year_text AS year, doc_type, source FROM ({_B})",
    "publish": f"SELECT c.doc_id, CASE WHEN g.ok THEN c.new_output ELSE p.old_output END AS output, g.ok AS published FROM ({plain(CANDIDATES, 'documents')}) c LEFT JOIN (SELECT doc_id, bool_and(accepted) AS ok FROM ({plain(GATES, 'documents')}) GROUP BY doc_id) g USING (doc_id) LEFT JOIN ({plain(PREVIOUS, 'documents')}) p USING (doc_id)",
}
