"""Corpus statistics: per document and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import sql as Q
from ..sources.tables import table

WINDOW = 1000


def diversity(plain: Column, window: int = WINDOW) -> Column:
    """struct(windows, distinct, ttr): the type-token ratio, for longer texts its mean over whole windows."""

    def of(w: Column) -> Column:
        n = F.floor(F.size(w) / window).cast("int")
        whole = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.size(F.array_distinct(F.slice(w, (i - 1) * window + 1, F.lit(window)))))
        total = F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x)
        short = F.size(F.array_distinct(w)).cast("long")
        distinct = F.when(n >= 1, total).otherwise(short)
        over = F.when(n >= 1, n * window).otherwise(F.size(w))
        return F.struct(n.alias("windows"), distinct.alias("distinct"), F.when(F.size(w) == 0, 0.0).otherwise(distinct / F.greatest(over, F.lit(1))).alias("ttr"))

    return F.transform(F.array(plain), of)[0]


def flags(text: Column, n_words: Column, dialogue_percent: Column, least_words: int = 5000, most_dialogue: float = 80.0) -> Column:
    checks = [("suspiciously_short", n_words < least_words), ("encoding_issues", F.size(X.encoding_issues(text)) > 0), ("high_dialogue_ratio", dialogue_percent > most_dialogue)]
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks)), lambda x: x.isNotNull())


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n", quote: tuple[str, str] = ("«", "»"), least_words: int = 5000) -> DataFrame:
    """One row a document with every per-file statistic."""
    t = F.col(text_col)
    got = docs.select(F.col(id_col), t, X.words(t).alias("words"), X.plain_words(t).alias("plain"), X.sentences(t).alias("sents"), X.paragraphs(t, separator).alias("paras"))
    n = F.size("words")
    dialogue = F.when(F.length(t) > 0, X.quoted_chars(t, *quote) * F.lit(100.0) / F.length(t)).otherwise(0.0)
    return got.select(
        id_col,
        n.cast("long").alias("word_count"),
        F.length(t).cast("long").alias("char_count"),
        F.size(F.array_distinct("plain")).cast("long").alias("unique_words"),
        _mean(F.aggregate("sents", F.lit(0), lambda a, s: a + X.word_count(s)), F.size("sents")).alias("avg_sentence_length"),
        _mean(F.aggregate("paras", F.lit(0), lambda a, p: a + F.size(X.sentences(p))), F.size("paras")).alias("avg_paragraph_length_sentences"),
        diversity(F.col("plain"))["ttr"].alias("lexical_diversity"),
        F.when(n > 0, F.map_from_arrays(F.array(*(F.lit(k) for k in X.MARKS)), F.array(*(X.occurrences(t, m) * F.lit(1000.0) / n for m in X.MARKS.values())))).otherwise(F.create_map().cast("map<string,double>")).alias("punctuation_density"),
        dialogue.alias("dialogue_ratio"),
        flags(t, n, dialogue, least_words).alias("flags"),
    )


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(0.0)


def corpus_totals(stats: DataFrame) -> DataFrame:
    """Totals and unweighted means over the documents of document_stats."""
    return stats.agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count("*").alias("total_files"),
        F.sum("word_count").alias("total_words"),
        F.sum("char_count").alias("total_chars"),
        F.avg("lexical_diversity").alias("avg_lexical_diversity"),
        F.avg("dialogue_ratio").alias("avg_dialogue_ratio"),
        (F.sum("word_count") * 2).alias("estimated_tokens"),
    ]


def stats_record(stats: DataFrame) -> DataFrame:
    """One nested row, for a JSON file: aggregate and files (document_stats by most words)."""
    keys = F.struct((-F.col("word_count")).alias("n"), F.monotonically_increasing_id().alias("i"))
    rows = stats.select("*", keys.alias("_k"))
    files = F.array_sort(F.collect_list(F.struct("_k", F.struct(*stats.columns).alias("s"))), lambda x, y: F.when(x["_k"] < y["_k"], -1).when(x["_k"] > y["_k"], 1).otherwise(0))
    return rows.agg(F.struct(*_totals()).alias("aggregate"), F.transform(files, lambda x: x["s"]).alias("files"))


def top_words(docs: DataFrame, by: list[str], k: int = 50, stopwords: list[str] = X.STOPWORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k most frequent words of each group, ties by first occurrence; no stopwords, no single characters.

    Counts are combined before the shuffle; only a group's distinct words meet in its window, and only k of
    each task's reach it."""
    rows = docs.select(*by, F.col(id_col).alias("_id"), F.posexplode(X.plain_words(F.col(text_col))).alias("_pos", "word"))
    rows = rows.where((F.length("word") > 1) & ~F.col("word").isin(stopwords))
    # one fixed-width number for whole ids, which hash aggregation takes
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    first = F.col("_id").cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("_pos").cast("decimal(10,0)") if whole else F.struct("_id", "_pos")
    counts = rows.groupBy(*by, "word").agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_first")


def report_text(stats: DataFrame, name: str = "filename") -> DataFrame:
    """report: totals, a paragraph a document of document_stats with most words first, and the flagged ones once more."""
    number = lambda c: F.format_number(c, 0)
    head = F.array_join(
        F.array(
            F.concat(F.lit("Files: "), number("total_files")), F.concat(F.lit("Words: "), number("total_words")), F.concat(F.lit("Characters: "), number("total_chars")),
            F.concat(F.lit("Estimated tokens: "), number("estimated_tokens")), F.format_string("Mean lexical diversity: %.4f", "avg_lexical_diversity"), F.format_string("Mean dialogue share: %.1f%%", "avg_dialogue_ratio"),
        ), "\n",
    )
    flagged = F.when(F.size("flags") > 0, F.concat(F.lit("\n  Flags: "), F.array_join("flags", ", "))).otherwise("")
    part = F.concat(
        F.col(name), F.lit("\n  Words: "), number("word_count"), F.lit(", characters: "), number("char_count"), F.format_string("\n  Sentence: %.1f words, paragraph: %.1f sentences", "avg_sentence_length", "avg_paragraph_length_sentences"),
        F.format_string("\n  Lexical diversity: %.4f, dialogue: %.1f%%", "lexical_diversity", "dialogue_ratio"), flagged,
    )
    line = F.when(F.size("flags") > 0, F.concat(F.col(name), F.lit(": "), F.array_join("flags", ", ")))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("word_count")).alias("n"), F.col(name).alias("f"), part.alias("t"), line.alias("l"))))  # a paragraph a file
    files, marked = (F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.array_join(F.transform("p", lambda x: x["l"]), "\n"))
    return stats.agg(*_totals(), parts.alias("p")).select(F.concat(head, F.lit("\n\n"), files, F.when(F.length(marked) > 0, F.concat(F.lit("\n\nFlagged\n"), marked)).otherwise("")).alias("report"))


def length_histogram(lengths: DataFrame, length_col: str, width: int) -> DataFrame:
    """bucket_lo, label, n of the buckets that hold anything."""
    lo = (F.floor(F.col(length_col) / width) * width).cast("long")
    return lengths.groupBy(lo.alias("bucket_lo")).agg(F.count("*").alias("n")).select("bucket_lo", F.concat(F.col("bucket_lo"), F.lit("-"), F.col("bucket_lo") + width).alias("label"), "n")


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *cols)


def doc_word_stats(spark: SparkSession, d: str) -> DataFrame:
    n = X.word_count(F.col("text")).cast("long")
    return _docs(spark, d).select("doc_id", n.alias("n_words"), F.length("text").cast("long").alias("n_characters"), (n * 2).alias("est_tokens"))


def corpus_aggregate_by_lang(spark: SparkSession, d: str) -> DataFrame:
    got = _docs(spark, d, "lang").select("lang", F.length("text").alias("c"), X.plain_words(F.col("text")).alias("p"), X.word_count(F.col("text")).alias("n"))
    got = got.select("lang", "c", "n", F.size(F.array_distinct("p")).alias("u"), (F.col("n") < 5000).cast("int").alias("short"))
    return got.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("total_words"), F.sum("c").alias("total_chars"), (F.sum("n") * 2).alias("est_tokens"),
        F.sum("u").alias("sum_unique_words"), (F.sum("n") / F.count("*")).alias("avg_words"), F.sum("short").cast("long").alias("n_short"),
    )


def lexical_diversity(spark: SparkSession, d: str) -> DataFrame:
    got = _docs(spark, d).select("doc_id", X.plain_words(F.col("text")).alias("p"))
    return got.select("doc_id", F.size("p").cast("long").alias("n_words"), diversity(F.col("p")).alias("x")).select("doc_id", "n_words", F.col("x.windows").cast("long").alias("n_windows"), F.col("x.distinct").alias("n_distinct"), F.col("x.ttr").alias("ttr"))


def sentence_paragraph_stats(spark: SparkSession, d: str) -> DataFrame:
    got = _docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s"), X.paragraphs(F.col("text"), "\n").alias("p"))
    got = got.select("doc_id", F.size("s").alias("ns"), F.size("p").alias("np"), F.aggregate("s", F.lit(0), lambda a, s: a + X.word_count(s)).alias("sw"), F.aggregate("p", F.lit(0), lambda a, p: a + F.size(X.sentences(p))).alias("ps"))
    return got.select("doc_id", F.col("ns").cast("long").alias("n_sentences"), F.col("np").cast("long").alias("n_paragraphs"), _mean(F.col("sw"), F.col("ns")).alias("avg_sentence_words"), _mean(F.col("ps"), F.col("np")).alias("avg_paragraph_sentences"))


def punctuation_density(spark: SparkSession, d: str) -> DataFrame:
    n = X.word_count(F.col("text"))
    marks = {"guillemets": "«", "em_dash": "—", "ellipsis": "…", "semicolon": ";", "colon": ":", "parentheses": "(", "full_stop": ".", "comma": ","}
    got = _docs(spark, d).select("doc_id", n.alias("n"), *(X.occurrences(F.col("text"), m).alias(k) for k, m in marks.items()))
    return got.select("doc_id", *(F.when(F.col("n") > 0, F.col(k) * F.lit(1000.0) / F.greatest("n", F.lit(1))).alias(k) for k in marks))


def dialogue_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = X.quoted_chars(F.col("text"), '"', '"').cast("long")
    return _docs(spark, d).select("doc_id", c.alias("quoted_chars"), F.when(F.length("text") > 0, c * F.lit(100.0) / F.length("text")).otherwise(0.0).alias("dialogue_percent"))


def top_words_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return top_words(_docs(spark, d, "lang"), ["lang"]).select("lang", "word", F.col("n"), F.col("rank").cast("long").alias("rank"))


def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    n, share = X.word_count(F.col("text")), X.quoted_chars(F.col("text"), '"', '"') * F.lit(100.0) / F.greatest(F.length("text"), F.lit(1))
    return _docs(spark, d).select("doc_id", F.array_join(flags(F.col("text"), n, share, 300, 1.0), ",").alias("flags"))


def length_histogram_256(spark: SparkSession, d: str) -> DataFrame:
    return length_histogram(_docs(spark, d).select((X.word_count(F.col("text")) * 2).alias("k")), "k", 256)


def length_histogram_5(spark: SparkSession, d: str) -> DataFrame:
    return length_histogram(_docs(spark, d).select(F.size(X.words(F.col("text"))).alias("k")), "k", 5)


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    """A line a source, most words first, as a report lists files."""
    got = table(spark, d, "documents").select("source", X.word_count(F.col("text")).alias("n"), F.length("text").alias("c"))
    got = got.groupBy("source").agg(F.sum("n").alias("words"), F.sum("c").alias("chars"))
    line = F.format_string("%s: %d words, %d characters", "source", "words", "chars")
    return got.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("w"), F.col("source").alias("s"), line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))


def document_stats_full(spark: SparkSession, d: str) -> DataFrame:
    return document_stats(_docs(spark, d), separator="\n", quote=('"', '"')).select(
        "doc_id", "word_count", "char_count", "unique_words", "avg_sentence_length", "avg_paragraph_length_sentences", "lexical_diversity", "dialogue_ratio", F.array_join("flags", ",").alias("flags")
    )


_W, _P, _S = Q.words("text"), Q.plain_words("text"), Q.sentences("text")
_QUOTED = "coalesce(list_sum(list_transform(regexp_extract_all(text, '\"([^\"]*)\"?', 1), lambda x: length(x))), 0)"
_TTR = """
div AS (SELECT doc_id, len(p) AS n, len(p) // 1000 AS k, len(list_distinct(p)) AS u,
        list_sum(list_transform(range(0, len(p) // 1000), lambda i: len(list_distinct(p[i * 1000 + 1:i * 1000 + 1000])))) AS s FROM pw)
"""
QUERIES = {
    f.__name__: f
    for f in (
        doc_word_stats, corpus_aggregate_by_lang, lexical_diversity, sentence_paragraph_stats, punctuation_density, dialogue_ratio,
        top_words_by_lang, quality_flags, length_histogram_256, length_histogram_5, corpus_report, document_stats_full,
    )
}
SQL = {
    "doc_word_stats": f"SELECT doc_id, CAST(len({_W}) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_characters, CAST(2 * len({_W}) AS BIGINT) AS est_tokens FROM documents",
    "corpus_aggregate_by_lang": f"""
WITH x AS (SELECT lang, length(text) AS c, len({_W}) AS n, len(list_distinct({_P})) AS u FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_words, CAST(sum(c) AS BIGINT) AS total_chars, CAST(2 * sum(n) AS BIGINT) AS est_tokens,
       CAST(sum(u) AS BIGINT) AS sum_unique_words, CAST(sum(n) AS DOUBLE) / count(*) AS avg_words, CAST(sum(CASE WHEN n < 5000 THEN 1 ELSE 0 END) AS BIGINT) AS n_short FROM x GROUP BY lang""",
    "lexical_diversity": f"""
WITH pw AS (SELECT doc_id, {_P} AS p FROM documents), {_TTR}
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(k AS BIGINT) AS n_windows, CAST(CASE WHEN k >= 1 THEN s ELSE u END AS BIGINT) AS n_distinct,
       CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN k >= 1 THEN CAST(s AS DOUBLE) / (k * 1000) ELSE CAST(u AS DOUBLE) / n END AS ttr FROM div""",
    "sentence_paragraph_stats": f"""
WITH x AS (SELECT doc_id, {_S} AS s, {Q.paragraphs("text")} AS p FROM documents),
y AS (SELECT doc_id, len(s) AS ns, len(p) AS np, list_sum(list_transform(s, lambda q: len({Q.words("q")}))) AS sw, list_sum(list_transform(p, lambda q: len({Q.sentences("q").replace("lambda x", "lambda z").replace("(x,", "(z,")}))) AS ps FROM x)
SELECT doc_id, CAST(ns AS BIGINT) AS n_sentences, CAST(np AS BIGINT) AS n_paragraphs, CASE WHEN ns > 0 THEN CAST(sw AS DOUBLE) / ns ELSE 0.0::DOUBLE END AS avg_sentence_words,
       CASE WHEN np > 0 THEN CAST(ps AS DOUBLE) / np ELSE 0.0::DOUBLE END AS avg_paragraph_sentences FROM y""",
    "punctuation_density": f"""
WITH x AS (SELECT doc_id, text, len({_W}) AS n FROM documents)
SELECT doc_id, """
    + ", ".join(f"CASE WHEN n > 0 THEN (length(text) - length(replace(text, '{m}', ''))) * 1000.0::DOUBLE / n END AS {k}" for k, m in (("guillemets", "«"), ("em_dash", "—"), ("ellipsis", "…"), ("semicolon", ";"), ("colon", ":"), ("parentheses", "("), ("full_stop", "."), ("comma", ",")))
    + " FROM x",
    "dialogue_ratio": f"SELECT doc_id, CAST({_QUOTED} AS BIGINT) AS quoted_chars, CASE WHEN length(text) > 0 THEN {_QUOTED} * 100.0::DOUBLE / length(text) ELSE 0.0::DOUBLE END AS dialogue_percent FROM documents",
    "top_words_by_lang": f"""
WITH x AS (SELECT lang, doc_id, unnest(p) AS word, unnest(range(0, len(p))) AS pos FROM (SELECT lang, doc_id, {_P} AS p FROM documents)),
c AS (SELECT lang, word, count(*) AS n, min(doc_id * 100000000 + pos) AS first FROM x WHERE length(word) > 1 AND word NOT IN ({", ".join(repr(w) for w in X.STOPWORDS)}) GROUP BY lang, word),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS rank FROM c)
SELECT lang, word, n, rank FROM r WHERE rank <= 50""",
    "quality_flags": f"""
SELECT doc_id, concat_ws(',', CASE WHEN len({_W}) < 300 THEN 'suspiciously_short' END,
       CASE WHEN contains(text, chr(0)) OR contains(text, chr(65533)) OR contains(text, '????') THEN 'encoding_issues' END,
       CASE WHEN {_QUOTED} * 100.0::DOUBLE / greatest(length(text), 1) > 1.0 THEN 'high_dialogue_ratio' END) AS flags FROM documents""",
    "length_histogram_256": f"SELECT CAST(k // 256 * 256 AS BIGINT) AS bucket_lo, (k // 256 * 256) || '-' || (k // 256 * 256 + 256) AS label, count(*) AS n FROM (SELECT 2 * len({_W}) AS k FROM documents) GROUP BY 1, 2",
    "length_histogram_5": f"SELECT CAST(k // 5 * 5 AS BIGINT) AS bucket_lo, (k // 5 * 5) || '-' || (k // 5 * 5 + 5) AS label, count(*) AS n FROM (SELECT len({_W}) AS k FROM documents) GROUP BY 1, 2",
    "corpus_report": f"""
WITH x AS (SELECT source, CAST(sum(len({_W})) AS BIGINT) AS w, CAST(sum(length(text)) AS BIGINT) AS c FROM documents GROUP BY source)
SELECT string_agg(source || ': ' || w || ' words, ' || c || ' characters', chr(10) ORDER BY w DESC, source) AS report FROM x""",
    "document_stats_full": f"""
WITH pw AS (SELECT doc_id, text, {_W} AS w, {_P} AS p, {_S} AS s, {Q.paragraphs("text")} AS q FROM documents), {_TTR},
y AS (SELECT *, {_QUOTED} AS quoted, list_sum(list_transform(s, lambda z: len({Q.words("z")}))) AS sw, list_sum(list_transform(q, lambda v: len({Q.sentences("v")}))) AS ps FROM pw)
SELECT y.doc_id, CAST(len(w) AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS char_count, CAST(div.u AS BIGINT) AS unique_words,
       CASE WHEN len(y.s) > 0 THEN CAST(sw AS DOUBLE) / len(y.s) ELSE 0.0::DOUBLE END AS avg_sentence_length,
       CASE WHEN len(q) > 0 THEN CAST(ps AS DOUBLE) / len(q) ELSE 0.0::DOUBLE END AS avg_paragraph_length_sentences,
       CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN k >= 1 THEN CAST(div.s AS DOUBLE) / (k * 1000) ELSE CAST(div.u AS DOUBLE) / n END AS lexical_diversity,
       CASE WHEN length(text) > 0 THEN quoted * 100.0::DOUBLE / length(text) ELSE 0.0::DOUBLE END AS dialogue_ratio,
       concat_ws(',', CASE WHEN len(w) < 5000 THEN 'suspiciously_short' END, CASE WHEN contains(text, chr(0)) OR contains(text, chr(65533)) OR contains(text, '????') THEN 'encoding_issues' END,
                 CASE WHEN quoted * 100.0::DOUBLE / greatest(length(text), 1) > 80 THEN 'high_dialogue_ratio' END) AS flags
FROM y JOIN div ON y.doc_id = div.doc_id""",
}
