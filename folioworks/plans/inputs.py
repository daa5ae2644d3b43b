"""Tables that queries derive from the driver's, as SQL that Spark and DuckDB both run."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of sql, in which {name} stands for a table."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def plain(sql: str, *tables: str) -> str:
    """The same SQL over views of these names."""
    for t in tables:
        sql = sql.replace("{" + t + "}", t)
    return sql


def spread(df: DataFrame, key: str, each: int = 4) -> DataFrame:
    """The rows dealt to `each` tasks for every core: few rows of a file can be much work, and Spark deals files by bytes."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * each, key)


#: One bibliography record per part; authors are separated by semicolons.
BIB = """
SELECT p_partkey AS item_pos, 'lib' || CAST(p_partkey % 20 AS STRING) AS library,
  CASE p_partkey % 5 WHEN 0 THEN 'Иванов; Петров' WHEN 1 THEN 'Smith' WHEN 2 THEN 'Kuhn; Lee; Brown; Adams' WHEN 3 THEN '' ELSE 'Щукин; Ёлкин; Жаров; Цой' END AS authors_text,
  CASE WHEN p_partkey % 5 IN (0, 4) THEN 'Исследование надёжности ' || p_name || ' для энергосистем' ELSE 'Measurement of ' || p_name || ' in ' || lower(p_type) || ' networks: application ' || CAST(p_size AS STRING) END AS title,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(1950 + p_partkey % 70 AS STRING) END AS year_text,
  CASE p_partkey % 12 WHEN 0 THEN 'article' WHEN 1 THEN 'book' WHEN 2 THEN 'dissertation' WHEN 3 THEN 'monograph' WHEN 4 THEN 'conference' WHEN 5 THEN 'patent'
    WHEN 6 THEN 'standard' WHEN 7 THEN 'abstract' WHEN 8 THEN 'report' WHEN 9 THEN 'collection' WHEN 10 THEN 'unknown' ELSE 'article' END AS doc_type,
  CASE WHEN p_partkey % 3 = 0 THEN 'Journal of ' || p_brand ELSE '' END AS source,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 9 AS STRING) ELSE '' END AS pages,
  CASE WHEN p_partkey % 7 = 0 THEN '10.1234/p' || CAST(p_partkey AS STRING) ELSE '' END AS doi,
  CASE WHEN p_partkey % 6 = 0 THEN '978-5-' || CAST(10000 + p_partkey AS STRING) || '-1' ELSE '' END AS isbn,
  CASE WHEN p_partkey % 8 = 0 THEN 'https://example.org/p/' || CAST(p_partkey AS STRING) ELSE '' END AS url
FROM {part}
"""

#: A raw reference per part, as it stands in a printed list.
RAW = """
SELECT p_partkey AS item_pos, CAST(p_partkey % 97 AS BIGINT) AS list_id,
  CASE p_partkey % 6 WHEN 0 THEN 'Иванов И.И., Петров П.П. ' WHEN 1 THEN 'Smith J., Kuhn T. ' WHEN 2 THEN 'IEEE Power Group, ' WHEN 3 THEN '' WHEN 4 THEN 'ГОСТ Р 7.0.100, ' ELSE 'Adams-Brown K. ' END
  || CASE WHEN p_partkey % 6 IN (0, 4) THEN 'Исследование надёжности ' || p_name ELSE 'Measurement of ' || p_name || ' in ' || lower(p_type) || ' networks' END
  || CASE p_partkey % 9 WHEN 0 THEN ' // Электричество. ' WHEN 1 THEN ': учебник. М.: Энергия, ' WHEN 2 THEN ': дис. ... канд. техн. наук. ' WHEN 3 THEN ': монография. ' WHEN 4 THEN '. Материалы конференции. ' WHEN 5 THEN '. Патент. ' WHEN 6 THEN '. Сборник статей. ' WHEN 7 THEN '. Отчёт. ' ELSE '. London, ' END
  || CAST(1950 + p_partkey % 70 AS STRING) || '. '
  || CASE WHEN p_partkey % 4 = 0 THEN 'с. ' || CAST(p_size AS STRING) || '-' || CAST(p_size + 9 AS STRING) || '. ' ELSE '' END
  || CASE WHEN p_partkey % 7 = 0 THEN 'doi: 10.1234/p' || CAST(p_partkey AS STRING) || ' ' ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN 'ISBN: 978-5-' || CAST(10000 + p_partkey AS STRING) || '-1 ' ELSE '' END
  || CASE WHEN p_partkey % 8 = 0 THEN 'https://example.org/p/' || CAST(p_partkey AS STRING) ELSE '' END AS raw_text
FROM {part}
"""
