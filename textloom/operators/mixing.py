"""Style mixes: adapter lists, recipes, backends, request bodies, footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table


def adapter_rows(lists: DataFrame, raw: str = "raw", lang: str = "lang") -> DataFrame:
    """id, label, index, lang from lists such as "id:Label,id:Label". A label may hold colons; an empty one is the id."""
    entries = lists.select(lang, F.posexplode(F.split(raw, ",")).alias("index", "e")).where(F.length("e") > 0)
    name = X.trimmed(F.substring_index("e", ":", 1))
    label = X.trimmed(F.regexp_replace("e", "^[^:]*:?", ""))
    return entries.select(name.alias("id"), F.coalesce(F.nullif(label, F.lit("")), name).alias("label"), "index", F.col(lang).alias("lang"))


def languages(adapters: DataFrame) -> DataFrame:
    """The languages that any adapter has."""
    return adapters.select("lang").where(F.col("lang").isNotNull()).distinct()


def active(weights: Column) -> Column:
    return F.map_filter(weights, lambda _, v: v > 0)


def prompt_language(en: Column, ru: Column) -> Column:
    """The language of a mix for its prompt: English only if it weighs more; unknown languages count to the other."""
    return F.when(en > ru, "en").otherwise("ru")


def backend_language(en: Column, has_en: bool = True) -> Column:
    """The backend that answers: English as soon as any English adapter is active and there is such a backend."""
    return F.when((en > 0) & F.lit(has_en), "en").otherwise("ru")


def recipes(mixes: DataFrame, adapters: DataFrame, key: str, weights: str, has_en: bool = True) -> DataFrame:
    """One row a mix that has an active weight: prompt_lang, backend_lang, mix (shares, in order of the adapters), lora.

    The adapters are a configuration list of a few rows, so they go to every task."""
    flat = mixes.select(key, F.explode(active(F.col(weights))).alias("id", "w"))
    met = flat.join(F.broadcast(adapters), "id", "left")
    total = met.groupBy(key).agg(
        F.sum("w").alias("total"),
        F.sum(F.when(F.col("lang") == "en", F.col("w")).otherwise(0.0)).alias("en"),
        F.sum(F.when(F.coalesce("lang", F.lit("")) != "en", F.col("w")).otherwise(0.0)).alias("ru"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("index", F.lit(-1)).alias("index"), "id", F.coalesce("label", "id").alias("label"), "w"))).alias("parts"),
    )
    share = lambda p: F.floor(p["w"] / F.col("total") * 100 + 0.5).cast("long")
    backend = backend_language(F.col("en"), has_en)
    return total.select(
        key,
        prompt_language(F.col("en"), F.col("ru")).alias("prompt_lang"),
        backend.alias("backend_lang"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["label"], F.lit(" "), share(p), F.lit("%"))), " + ").alias("mix"),
        F.transform(F.filter("parts", lambda p: (p["lang"] == backend) & (p["index"] >= 0)), lambda p: F.struct(p["index"].alias("id"), p["w"].alias("scale"))).alias("lora"),
    )


def request_body(temperature: Column, max_tokens: Column, top_p: Column, repeat_penalty: Column, frequency_penalty: Column) -> Column:
    """JSON of the options; zero counts as missing, the repeat penalty is 1.1 by default."""
    some = lambda c: F.nullif(c, F.lit(0))
    return F.to_json(F.struct(some(temperature).alias("temperature"), some(max_tokens).alias("max_tokens"), some(top_p).alias("top_p"), F.coalesce(repeat_penalty, F.lit(1.1)).alias("repeat_penalty"), some(frequency_penalty).alias("frequency_penalty")))


def footer(mix: Column, temperature: Column, max_tokens: Column, enhanced: Column) -> Column:
    """The parts that are there, by middle dots."""
    tag = lambda name, c: F.when(c != 0, F.concat(F.lit(name), c))
    return F.concat_ws(" · ", F.nullif(mix, F.lit("")), tag("t=", temperature), tag("len=", max_tokens), F.when(enhanced.isNotNull() & (enhanced != ""), "enhanced"))


def adapters(spark: SparkSession) -> DataFrame:
    rows = [("a1:First, a2 : Second: two ,a3:", "ru"), ("b1:North,b2:South", "en")]
    return adapter_rows(spark.createDataFrame(rows, "raw string, lang string"))


def adapter_list(spark: SparkSession, d: str) -> DataFrame:
    return adapters(spark)


def mix_recipe(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    name = F.when(F.col("event_type") == "click", "a1").when(F.col("event_type") == "view", "b1").when(F.col("event_type") == "purchase", "b2").otherwise("zz")
    weights = pairs.groupBy("user_id", name.alias("id")).agg((F.greatest(F.sum("c") - 10, F.lit(0)) * 0.25).alias("w"))
    mixes = weights.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "w"))).alias("weights"))
    return recipes(mixes, adapters(spark), "user_id", "weights").select("user_id", "prompt_lang", "backend_lang", "mix", F.array_join(F.transform("lora", lambda x: F.concat_ws(":", x["id"], x["scale"].cast("decimal(12,2)"))), ",").alias("lora"))


def generation_footer(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "conversations")
    return got.select("conv_id", "turn", footer(F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("turn") % 3, F.length("text"), F.when(F.col("conv_id") % 2 == 1, F.col("text"))).alias("footer"))


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "conversations")
    body = request_body((F.col("turn") % 2) * 0.5, F.col("turn") * 100, F.lit(None).cast("double"), F.when(F.col("turn") > 2, 1.25), F.lit(0.0))
    return got.select("conv_id", "turn", body.alias("body"))


QUERIES = {f.__name__: f for f in (adapter_list, mix_recipe, generation_footer, request_bodies)}
SQL = {
    "adapter_list": "SELECT id, label, CAST(idx AS INTEGER) AS index, lang FROM (VALUES ('a1', 'First', 0, 'ru'), ('a2', 'Second: two', 1, 'ru'), ('a3', 'a3', 2, 'ru'), ('b1', 'North', 0, 'en'), ('b2', 'South', 1, 'en')) t(id, label, idx, lang)",
    "mix_recipe": """
WITH n AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'a1' WHEN 'view' THEN 'b1' WHEN 'purchase' THEN 'b2' ELSE 'zz' END AS id FROM events),
w AS (SELECT user_id, id, greatest(count(*) - 10, 0) * 0.25::DOUBLE AS w FROM n GROUP BY user_id, id HAVING count(*) > 10),
a(id, label, idx, lang) AS (VALUES ('a1', 'First', 0, 'ru'), ('b1', 'North', 0, 'en'), ('b2', 'South', 1, 'en')),
x AS (SELECT user_id, w.id, coalesce(label, w.id) AS label, coalesce(idx, -1) AS idx, coalesce(lang, '') AS lang, w, sum(w) OVER (PARTITION BY user_id) AS t,
      sum(CASE WHEN lang = 'en' THEN w ELSE 0 END) OVER (PARTITION BY user_id) AS en FROM w LEFT JOIN a ON a.id = w.id)
SELECT user_id, max(CASE WHEN en > t - en THEN 'en' ELSE 'ru' END) AS prompt_lang, max(CASE WHEN en > 0 THEN 'en' ELSE 'ru' END) AS backend_lang,
       string_agg(label || ' ' || CAST(floor(w / t * 100 + 0.5) AS BIGINT) || '%', ' + ' ORDER BY lang, idx, id) AS mix,
       coalesce(string_agg(idx || ':' || CAST(w AS DECIMAL(12, 2)), ',' ORDER BY lang, idx, id) FILTER (idx >= 0 AND lang = CASE WHEN en > 0 THEN 'en' ELSE 'ru' END), '') AS lora
FROM x GROUP BY user_id""",
    "generation_footer": "SELECT conv_id, turn, concat_ws(' · ', CASE WHEN turn % 2 = 0 THEN role END, CASE WHEN turn % 3 <> 0 THEN 't=' || (turn % 3) END, CASE WHEN length(text) <> 0 THEN 'len=' || length(text) END, CASE WHEN conv_id % 2 = 1 AND text <> '' THEN 'enhanced' END) AS footer FROM conversations",
    "request_bodies": """SELECT conv_id, turn, '{' || concat_ws(',', CASE WHEN turn % 2 = 1 THEN '"temperature":0.5' END, CASE WHEN turn <> 0 THEN '"max_tokens":' || turn * 100 END,
 '"repeat_penalty":' || CASE WHEN turn > 2 THEN '1.25' ELSE '1.1' END) || '}' AS body FROM conversations""",
}
