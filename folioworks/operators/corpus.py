"""Row-wise text jobs, e-mail reports, classification and exact duplicates over the documents table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import helpers, text as T
from ..plans.inputs import BIB, derived, plain, table

#: Document types from specific to general, and the words that show them.
DOC_TYPES = ["abstract", "dissertation", "standard", "patent", "monograph", "conference", "collection", "book", "report", "article"]
KEYWORDS = {
    "abstract": ["автореферат", "реферат", "abstract"],
    "dissertation": ["диссертация", "дис.", "кандидат", "доктор"],
    "standard": ["стандарт", "гост", "снип"],
    "patent": ["патент", "пат.", "изобретение", "полезная модель"],
    "monograph": ["монография", "научное издание"],
    "conference": ["материалы", "тезисы", "конференц", "симпозиум", "труды конференц"],
    "collection": ["сборник", "редколлегия", "составитель"],
    "book": ["учебник", "учебное пособие", "издательство", "isbn", "том"],
    "report": ["отчёт", "отчет", "нтр", "грант", "проект", "методическ"],
    "article": ["статья", "журнал", "doi", "introduction", "conclusion"],
}
MAX_BLOCK_CHARS = 1_000_000


def extract_emails(docs: DataFrame) -> DataFrame:
    """doc_id, emails, n of documents that have any."""
    return docs.select("doc_id", T.emails(F.col("text")).alias("emails")).where(F.size("emails") > 0)


def emails_by_document(pages: DataFrame, least_text: int = 50) -> DataFrame:
    """Pages (doc_id, page, text) to total, text and OCR pages and all addresses of a document; a page with little text is an OCR page."""
    is_text = F.length(T.strip(F.coalesce("text", F.lit("")))) > least_text
    rows = pages.select("doc_id", is_text.alias("is_text"), T.emails(F.col("text")).alias("found"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if("is_text").alias("text_pages"),
        F.count_if(~F.col("is_text")).alias("ocr_pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("emails"),
    )


def email_report(docs: DataFrame, by: str = "source") -> DataFrame:
    """Distinct addresses of each group, or that there are none; distinct before they are listed."""
    found = docs.select(by, F.explode(T.emails(F.col("text"))).alias("email")).distinct()
    listed = found.groupBy(by).agg(F.count("*").alias("n_emails"), F.array_join(F.array_sort(F.collect_list("email")), "\n").alias("report"))
    return docs.select(by).distinct().join(listed, by, "left").select(by, F.coalesce("n_emails", F.lit(0)).alias("n_emails"), F.coalesce("report", F.lit("not found")).alias("report"))


def to_blocks(docs: DataFrame, most: int = MAX_BLOCK_CHARS) -> DataFrame:
    """One row per line (CRLF and CR are line ends, blank lines stay): doc_id, pos, kind, text; texts with control characters or over `most` characters are rejected as a whole."""
    good = docs.where(F.col("text").isNotNull() & (F.length("text") <= most) & ~T.has_control(F.col("text")))
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return good.select("doc_id", F.posexplode(lines).alias("pos", "text")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit("paragraph").alias("kind"), "text")


def search_library(bib: DataFrame, query: str) -> DataFrame:
    everything = F.concat_ws(" ", F.array_join("authors", ", "), "title", F.coalesce(F.col("year").cast("string"), F.lit("")))
    return bib.where(F.lower(everything).contains(query.lower()))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, doc_type, confidence and scores by keyword hits; ties go to the more specific type, blank texts are unknown."""
    low = F.lower(F.coalesce("text", F.lit("")))
    score = {t: F.least(F.lit(1.0), sum((low.contains(w).cast("int") for w in KEYWORDS[t]), F.lit(0)) / F.lit(float(len(KEYWORDS[t]))) * 2) for t in DOC_TYPES}
    scores = F.array(*(F.struct(score[t].alias("score"), F.lit(-i).alias("place"), F.lit(t).alias("type")) for i, t in enumerate(DOC_TYPES)))
    rows = docs.select("doc_id", scores.alias("scores")).withColumn("best", F.array_max("scores"))
    known = F.col("best.score") > 0
    return rows.select("doc_id", F.when(known, F.col("best.type")).otherwise("unknown").alias("doc_type"), F.col("best.score").alias("confidence"), F.map_from_entries(F.transform("scores", lambda s: F.struct(s["type"], s["score"]))).alias("scores"))


def type_counts(classified: DataFrame) -> DataFrame:
    """Count and share of each type."""
    counted = classified.groupBy("doc_type").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("doc_type", "n", (F.col("n") / F.col("total")).alias("share"))  # total is one row


def content_hash(docs: DataFrame, content: Column | None = None) -> DataFrame:
    c = F.col("text") if content is None else content
    return docs.select("doc_id", F.sha2(c, 256).alias("sha256"), F.md5(c).alias("md5"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """sha256, members, first member of contents that occur more than once; hashes, not contents, are shuffled."""
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256")).where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


def duplicate_map(docs: DataFrame) -> DataFrame:
    """doc_id, first_id for every document whose content another one has too; a group of any size stays in long form."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.join(duplicate_groups(docs).select("sha256", "first_id"), "sha256").select("doc_id", "first_id")


def filter_tasks(tasks: DataFrame, state: str = "all", query: str = "") -> DataFrame:
    """Tasks (status, filename) of a group of states whose name contains query."""
    groups = {"active": ["queued", "running", "cancelling"], "done": ["done"], "attention": ["error", "interrupted", "cancelled", "expired"]}
    kept = tasks if state == "all" else tasks.where(F.col("status").isin(groups[state]))
    return kept.where(F.lower("filename").contains(query.lower()))


def normalize_bib(raw: DataFrame) -> DataFrame:
    """Records with authors split at semicolons, blank ones dropped; a year that is not all digits is null."""
    authors = F.filter(F.transform(F.split("authors_text", ";"), lambda a: F.trim(a)), lambda a: a != "")
    return raw.withColumn("authors", authors).withColumn("year", F.when(F.col("year_text").rlike(r"^\d+$"), F.col("year_text").try_cast("int"))).drop("authors_text", "year_text")


PAGES = "SELECT doc_id, 0 AS page, text FROM {documents} UNION ALL SELECT doc_id, 1, 'page ' || CAST(doc_id AS STRING) || ' mail me@example.org' FROM {documents} WHERE doc_id % 3 = 0"
SQL_EMAILS = f"list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '{T.EMAIL}'), lambda e: lower(regexp_extract(e, '\\.([a-zA-Z]+)$', 1)) NOT IN ('abc', 'test', 'invalid', 'localhost', 'example') AND length(regexp_extract(e, '\\.([a-zA-Z]+)$', 1)) <= 5)))"
TASKS = """
SELECT o_orderkey AS task_id, 'file_' || CAST(o_orderkey % 1000 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.docx' ELSE '.PDF' END AS filename,
  CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'error' WHEN 3 THEN 'interrupted' WHEN 4 THEN 'cancelled' ELSE 'done' END AS status
FROM {orders}
"""
_letters = str.maketrans(*T.ONE_LETTER)
_NAME = "'Отчёт: ' || p_name || ' — Щит (' || lower(p_brand) || ') ' || p_type || ' and a rather long tail of words'"


def _normalized(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({e})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _translit(e: str) -> str:
    out = f"translate(lower({e}), '{T.ONE_LETTER[0]}', '{T.ONE_LETTER[1]}')"
    for a, b in T.MANY_LETTERS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _joined(df: DataFrame, column: str = "emails") -> DataFrame:
    return df.withColumn(column, F.array_join(column, ","))


def _named(s, d):
    return derived(s, d, f"SELECT p_partkey, {_NAME} AS name FROM {{part}}", "part")


def _classified(s, d):
    return classify(derived(s, d, "SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Диссертация кандидат' WHEN 1 THEN ' abstract introduction' WHEN 2 THEN ' ГОСТ стандарт' ELSE '' END AS text FROM {documents}", "documents"))


_SQL_SCORES = ", ".join(f"least(1.0::DOUBLE, ({' + '.join(f'contains(low, {w!r})::INT' for w in KEYWORDS[t])}) / {float(len(KEYWORDS[t]))}::DOUBLE * 2) AS s{i}" for i, t in enumerate(DOC_TYPES))
_SQL_CLASSIFIED = f"""
SELECT doc_id, CASE {' '.join(f"WHEN s{i} = best AND best > 0 THEN '{t}'" for i, t in enumerate(DOC_TYPES))} ELSE 'unknown' END AS doc_type, best AS confidence
FROM (SELECT *, greatest({', '.join(f's{i}' for i in range(len(DOC_TYPES)))}) AS best FROM (SELECT doc_id, {_SQL_SCORES} FROM (
  SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' Диссертация кандидат' WHEN 1 THEN ' abstract introduction' WHEN 2 THEN ' ГОСТ стандарт' ELSE '' END) AS low FROM documents)))
"""

QUERIES = {
    "emails_extract": lambda s, d: _joined(extract_emails(table(s, d, "documents"))),
    "emails_by_document": lambda s, d: _joined(emails_by_document(derived(s, d, f"SELECT * FROM ({PAGES}) UNION ALL SELECT doc_id, page + 10, 'one more page of text that is longer than fifty characters' FROM ({PAGES})", "documents"))),
    "emails_report": lambda s, d: email_report(table(s, d, "documents")),
    "normalize_text": lambda s, d: table(s, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized")),
    "keywords": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(T.keywords(T.normalize_text(F.col("text")))), " ").alias("keywords")),
    "transliterate": lambda s, d: _named(s, d).select("p_partkey", T.transliterate(F.col("name")).alias("latin")),
    "normalize_filename": lambda s, d: _named(s, d).select("p_partkey", T.normalize_filename(F.col("name")).alias("file")),
    "sanitize_filename": lambda s, d: table(s, d, "pages").select("page_id", T.sanitize_filename(F.col("url")).alias("file")),
    "to_blocks": lambda s, d: to_blocks(table(s, d, "documents")),
    "search_library": lambda s, d: search_library(normalize_bib(derived(s, d, BIB, "part")), "Kuhn, Lee").select("item_pos", "title"),
    "filter_tasks": lambda s, d: filter_tasks(derived(s, d, TASKS, "orders"), "attention", "FILE_1"),
    "html_to_blocks": lambda s, d: table(s, d, "pages").select("page_id", "html").mapInArrow(helpers.html_rows, "page_id long, pos long, kind string, level long, text string"),
    "normalize_bib": lambda s, d: normalize_bib(derived(s, d, BIB, "part")).select("item_pos", F.array_join("authors", "|").alias("authors"), "year", "title"),
    "classify": lambda s, d: _classified(s, d).drop("scores"),
    "type_counts": lambda s, d: type_counts(_classified(s, d)),
    "content_hash": lambda s, d: content_hash(table(s, d, "documents")),
    "duplicate_groups": lambda s, d: duplicate_groups(table(s, d, "documents")),
    "duplicate_map": lambda s, d: duplicate_map(table(s, d, "documents")),
}

SQL = {
    "emails_extract": f"SELECT doc_id, array_to_string(e, ',') AS emails FROM (SELECT doc_id, {SQL_EMAILS} AS e FROM documents) WHERE len(e) > 0",
    "emails_by_document": f"""
        WITH p AS ({plain(PAGES, 'documents')}), q AS (SELECT * FROM p UNION ALL SELECT doc_id, page + 10, 'one more page of text that is longer than fifty characters' FROM p)
        SELECT doc_id, count(*) AS total_pages, count(*) FILTER (t) AS text_pages, count(*) FILTER (NOT t) AS ocr_pages, array_to_string(list_sort(list_distinct(flatten(list(e)))), ',') AS emails
        FROM (SELECT doc_id, length(trim(text, ' ' || chr(10))) > 50 AS t, {SQL_EMAILS} AS e FROM q) GROUP BY doc_id""",
    "emails_report": f"""
        SELECT source, coalesce(n, 0) AS n_emails, coalesce(report, 'not found') AS report FROM (SELECT DISTINCT source FROM documents)
        LEFT JOIN (SELECT source, count(*) AS n, string_agg(email, chr(10) ORDER BY email) AS report FROM (SELECT DISTINCT source, unnest({SQL_EMAILS}) AS email FROM documents) GROUP BY source) USING (source)""",
    "normalize_text": f"SELECT doc_id, {_normalized('text')} AS normalized FROM documents",
    "keywords": f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({_normalized('text')}, '{T.KEYWORD}'))), ' ') AS keywords FROM documents",
    "transliterate": f"SELECT p_partkey, {_translit('name')} AS latin FROM (SELECT p_partkey, {_NAME} AS name FROM part)",
    "normalize_filename": f"""
        SELECT p_partkey, trim(lower(CASE WHEN length(o) > 50 THEN CASE WHEN length(c) > 47 THEN substr(c, 1, 47) || '...' ELSE c END ELSE o END), '_') AS file
        FROM (SELECT p_partkey, o, rtrim(substr(o, 1, 50), '_') AS c FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace({_NAME}, '[^\\p{{L}}\\p{{N}}_\\s\\-]', '', 'g'), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g') AS o FROM part))""",
    "sanitize_filename": """SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '_') AS file FROM pages""",
    "to_blocks": "SELECT doc_id, unnest(range(len(l))) AS pos, 'paragraph' AS kind, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "search_library": f"SELECT item_pos, title FROM ({plain(BIB, 'part')}) WHERE lower(replace(authors_text, '; ', ', ') || ' ' || title || ' ' || year_text) LIKE '%kuhn, lee%'",
    "filter_tasks": f"SELECT * FROM ({plain(TASKS, 'orders')}) WHERE status IN ('error', 'interrupted', 'cancelled', 'expired') AND lower(filename) LIKE '%file\\_1%' ESCAPE '\\'",
    "normalize_bib": f"SELECT item_pos, replace(authors_text, '; ', '|') AS authors, try_cast(nullif(year_text, '') AS INT) AS year, title FROM ({plain(BIB, 'part')})",
    "classify": _SQL_CLASSIFIED,
    "type_counts": f"SELECT doc_type, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS share FROM ({_SQL_CLASSIFIED}) GROUP BY doc_type",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
    "duplicate_groups": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicate_map": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1",
}
