"""Queries over web pages and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.markup import html_text, without_end_matter
from ..sources.readers import curated
from ..sources.tables import table
from . import sql as Q


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.trimmed(html_text(F.col("html"))).alias("text"))


def page_min_words(spark: SparkSession, d: str) -> DataFrame:
    n = X.word_count(html_text(F.col("html")))
    return table(spark, d, "pages").select("page_id", n.cast("long").alias("n_words")).where("n_words > 60")


def curate_catalog(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws("_", "p_name", F.col("p_partkey") % 12).alias("name"), F.col("p_partkey") * 7 % 9000)
    parts = parts.toDF("p_partkey", "name", "n")
    return curated(parts, "name", F.col("n"), ["RED", "azure"], ["b", "st"], 3000).select("p_partkey", "name")


def end_matter(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.lit(" \nISBN 978"))
    return table(spark, d, "documents").select("doc_id", F.sha2(without_end_matter(t, ["ISBN ", "УДК "], 0.5), 256).alias("text_hash"))


_BLOCKS = "".join(f"|<{t}\\b[^>]*>.*?</{t}\\s*>" for t in ("script", "style", "nav", "header", "footer"))
_TEXT = "regexp_replace(html, '<!--.*?-->" + _BLOCKS + "', '', 'gis')"
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '<(?:p|br|div|h1|h2|h3)\\b[^>]*>|</p\\s*>', chr(10), 'gi'), '</?[A-Za-z!][^>]*>', '', 'gs')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_name}', '{_char}')"
QUERIES = {f.__name__: f for f in (html_to_text, page_min_words, curate_catalog, end_matter)}
SQL = {
    "html_to_text": f"SELECT page_id, {Q.trimmed(_TEXT)} AS text FROM pages",
    "page_min_words": f"SELECT page_id, CAST(len({Q.words(_TEXT)}) AS BIGINT) AS n_words FROM pages WHERE len({Q.words(_TEXT)}) > 60",
    "curate_catalog": """
WITH x AS (SELECT p_partkey, p_name || '_' || (p_partkey % 12) AS name, p_partkey * 7 % 9000 AS n FROM part)
SELECT p_partkey, name FROM x WHERE NOT regexp_matches(name, '_[2-8]$') AND n >= 3000 AND NOT contains(lower(name), 'red') AND NOT contains(lower(name), 'azure') AND (contains(lower(name), 'b') OR contains(lower(name), 'st'))""",
    "end_matter": r"SELECT doc_id, sha256(CASE WHEN length(text) + 2 >= floor((length(text) + 10) * 0.5) THEN regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '') ELSE text || ' ' || chr(10) || 'ISBN 978' END) AS text_hash FROM documents",
}
