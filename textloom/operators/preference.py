"""Preference pairs from scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table


def parsed_score(reply: Column) -> Column:
    """struct(adherence, style, total) of a judge's JSON reply, fenced or not; 5 for what is missing."""
    body = X.unfenced(reply)
    part = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}").try_cast("int"), F.lit(5))
    return F.struct(part("adherence").alias("adherence"), part("style").alias("style"), (part("adherence") + part("style")).alias("total"))


def preference_pairs(scored: DataFrame, keys: list[str], idx: str, text: str, adherence: str, style: str, least: int = 2, min_gap: int = 3) -> DataFrame:
    """One row a group of at least `least` candidates whose best and worst differ by min_gap or more.

    Of equal totals the best is the one of the lowest index, the worst that of the highest: one aggregation
    with map-side combine, no window, so a large group costs no sort."""
    total = F.col(adherence) + F.col(style)
    body = F.struct(F.col(idx).alias("idx"), F.col(text).alias("text"), F.col(adherence).cast("int").alias("adherence"), F.col(style).cast("int").alias("style"))
    got = scored.groupBy(*keys).agg(
        F.max_by(body, F.struct(total, -F.col(idx))).alias("b"), F.min_by(body, F.struct(total, -F.col(idx))).alias("w"), F.count("*").alias("n"), (F.max(total) - F.min(total)).cast("int").alias("score_gap")
    )
    pair = lambda x: F.struct(F.col(f"{x}.adherence").alias("adherence"), F.col(f"{x}.style").alias("style"))
    return got.where((F.col("n") >= least) & (F.col("score_gap") >= min_gap)).select(
        *keys, F.col("b.text").alias("chosen"), F.col("w.text").alias("rejected"), pair("b").alias("chosen_score"), pair("w").alias("rejected_score"), "score_gap", F.lit(True).alias("needs_review")
    )


def exploded(sets: DataFrame, keys: list[str], completions: str = "completions") -> DataFrame:
    """A row a completion, with its place in the set."""
    return sets.select(*keys, F.posexplode(completions).alias("idx", "c")).select(*keys, "idx", "c.*")


def temperatures(n: Column, first: list[float] = (0.7, 0.85, 1.0)) -> Column:
    """The first n temperatures, continued by 0.8 + 0.1 k."""
    more = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda k: F.lit(0.8) + k * F.lit(0.1))
    return F.slice(F.concat(F.array(*(F.lit(x) for x in first)), more), F.lit(1), n)


def review_card(number: Column, prompt: Column, body: Column, shown: int = 600) -> Column:
    """An HTML card for human review."""
    return F.format_string('<section class="card"><h2>%d</h2><p class="prompt">%s</p><div class="text">%s</div></section>', number, X.html_escaped(prompt), X.html_escaped(F.left(body, F.lit(shown))))


def evaluation_page(results: DataFrame, title: str = "Evaluation") -> DataFrame:
    """html: one page of cards of generated texts (id, prompt, text) in order of id, for a reviewer's scores; a prompt set's size bounds it."""
    card = review_card(F.col("id"), F.col("prompt"), F.col("text"), shown=2**31 - 1)
    score = F.lit('<form><label>adherence <input name="adherence" type="number" min="1" max="10"></label><label>style <input name="style" type="number" min="1" max="10"></label><input name="note"></form>')
    cards = F.array_sort(F.collect_list(F.struct("id", F.concat(card, score).alias("c"))))
    body = F.array_join(F.transform(cards, lambda x: x["c"]), "\n")
    return results.agg(F.concat(F.lit(f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body>\n'), body, F.lit("\n</body></html>\n")).alias("html"))


def _scored(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "text", *keys), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(*keys, "doc_id", "text", F.when(F.col("quality") == 1, 8).otherwise(3).alias("adherence"), (9 - 6 * F.col("toxic")).alias("style"))


def _pairs(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    got = preference_pairs(_scored(spark, d, keys), keys, "doc_id", "text", "adherence", "style")
    return got.select(*keys, F.sha2("chosen", 256).alias("chosen_hash"), F.sha2("rejected", 256).alias("rejected_hash"), F.col("chosen_score.adherence").alias("chosen_adherence"), F.col("rejected_score.style").alias("rejected_style"), "score_gap")


def preference_pairs_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, ["source"])


def preference_pairs_by_source_lang(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, ["source", "lang"])


def score_parse(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('```json\n{"adherence": '), F.col("quality") + 2, F.lit(', "style": 7}\n```'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"style": '), F.col("toxic"), F.lit("}"))).otherwise("no json")
    return table(spark, d, "labels").select("doc_id", parsed_score(reply).alias("s")).select("doc_id", "s.*")


def completion_means(spark: SparkSession, d: str) -> DataFrame:
    got = _scored(spark, d, ["source"]).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("adherence") + F.col("style")).alias("s"))
    return got.select("source", "n", (F.col("s") / F.col("n")).alias("mean_total"))


def review_cards(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "benchmark")
    return got.select("item_id", review_card(F.col("item_id"), F.concat(F.lit("<item> & "), F.col("item_id")), F.col("text")).alias("card"))


def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "benchmark").select("item_id", F.posexplode(temperatures((F.col("item_id") % 6 + 1).cast("int"))).alias("k", "temperature"))
    return got.select("item_id", F.col("k").cast("long").alias("k"), F.round("temperature", 2).alias("temperature"))


def _pair_sql(keys: str) -> str:
    return f"""
WITH x AS (SELECT {keys}, d.doc_id, text, CASE WHEN quality = 1 THEN 8 ELSE 3 END AS a, 9 - 6 * toxic AS s FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY a + s DESC, doc_id) AS b, row_number() OVER (PARTITION BY {keys} ORDER BY a + s, doc_id DESC) AS w FROM x)
SELECT {keys}, sha256(max(CASE WHEN b = 1 THEN text END)) AS chosen_hash, sha256(max(CASE WHEN w = 1 THEN text END)) AS rejected_hash, CAST(max(CASE WHEN b = 1 THEN a END) AS INTEGER) AS chosen_adherence,
       CAST(max(CASE WHEN w = 1 THEN s END) AS INTEGER) AS rejected_style, CAST(max(a + s) - min(a + s) AS INTEGER) AS score_gap
FROM r GROUP BY {keys} HAVING count(*) >= 2 AND max(a + s) - min(a + s) >= 3"""


_CARD = "'<section class=\"card\"><h2>' || item_id || '</h2><p class=\"prompt\">&lt;item> &amp; ' || item_id || '</p><div class=\"text\">' || replace(replace(replace(left(text, 600), '&', '&amp;'), '<', '&lt;'), chr(10), '<br>') || '</div></section>'"
QUERIES = {f.__name__: f for f in (preference_pairs_by_source, preference_pairs_by_source_lang, score_parse, completion_means, review_cards, temperature_grid)}
SQL = {
    "preference_pairs_by_source": _pair_sql("source"),
    "preference_pairs_by_source_lang": _pair_sql("source, lang"),
    "score_parse": """
WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN quality + 2 ELSE 5 END AS a, CASE doc_id % 3 WHEN 0 THEN 7 WHEN 1 THEN toxic ELSE 5 END AS s FROM labels)
SELECT doc_id, CAST(a AS INTEGER) AS adherence, CAST(s AS INTEGER) AS style, CAST(a + s AS INTEGER) AS total FROM x""",
    "completion_means": """
WITH x AS (SELECT source, CASE WHEN quality = 1 THEN 8 ELSE 3 END + 9 - 6 * toxic AS t FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, count(*) AS n, CAST(sum(t) AS DOUBLE) / count(*) AS mean_total FROM x GROUP BY source""",
    "review_cards": f"SELECT item_id, {_CARD} AS card FROM benchmark",
    "temperature_grid": """
WITH x AS (SELECT item_id, unnest(range(0, item_id % 6 + 1)) AS k FROM benchmark)
SELECT item_id, k, CASE k WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE round(0.8::DOUBLE + 0.1::DOUBLE * (k - 3), 2) END AS temperature FROM x""",
}
