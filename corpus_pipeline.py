"""From raw documents to packed training sequences, in five stages.

Each stage works on all its predecessor kept and takes effect: documents without a language
go, one document of each near-duplicate group stays, contaminated documents go and single
leaked passages are cut out, personal data is replaced by its kind, and what is left is
packed. Every stage but the last returns the columns of documents.

Findings come back to the documents by id and hash of the text, so rows that repeat an id
with other texts, and rows without id, are told apart. Documents may have any other
columns: findings are joined as columns of their own table and never added by name. An
empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, language, near_dup, packing, pii
from textloom.llm.common import cut, table

#: Bytes, about, that a side of a join may have to be sent to every task; larger sides are joined by shuffle.
SENT_MOST = 64 << 20
ROW_BYTES, SPAN_BYTES = 64, 64
#: A text of at least this many letters whose best language needs nearly as many phrases as the second is in none of the learned ones.
UNSURE_LETTERS, UNSURE = 400, 0.01


def _bounded(side: DataFrame) -> DataFrame:
    """side, which is checkpointed, to be broadcast if its rows and spans are few enough."""
    spans = F.sum(F.greatest(F.size("spans"), F.lit(0))) if "spans" in side.columns else F.lit(0)
    n = side.agg((F.count("*") * ROW_BYTES + F.coalesce(spans, F.lit(0)) * SPAN_BYTES).alias("n")).first()["n"]
    return F.broadcast(side) if n <= SENT_MOST else side


def _hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _same(docs: DataFrame, found: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(found["doc_id"]) & (_hash(docs) == found["text_hash"])


def _anew(found: DataFrame, *columns: str) -> DataFrame:
    """The columns as new ones, which no join takes for those of an earlier finding."""
    return found.select(*(F.col(c).alias(c) for c in columns))


def _keys(found: DataFrame) -> DataFrame:
    return cut(_anew(found, "doc_id", "text_hash").distinct())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id (null is one) and hash of the text gone names."""
    gone = _bounded(gone)
    return docs.join(gone, _same(docs, gone), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language: texts without a letter go (null and empty ones too), and long ones that no learned
    language explains better than another. Of rows that repeat id and text all stay or all go."""
    found = language.identify(docs, docs)
    unsure = (F.col("score") < UNSURE) & (F.col("n_letters") >= UNSURE_LETTERS)
    return _without(docs, _keys(found.where((F.col("lang_pred") == language.UNKNOWN) | unsure)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Of rows that repeat id (null is one) and text one stays. An id's other texts are documents
    of their own. Texts without words are in no group, nor are rows without id.
    """
    found = cut(near_dup.near_duplicates(docs))
    docs = _without(docs, _keys(found.where(~F.col("kept"))))
    repeated = _keys(found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1"))
    if repeated.isEmpty():
        return docs
    some = _bounded(repeated)
    once = docs.join(some, _same(docs, some), "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(docs, repeated).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of two benchmark items or more go; a passage of one item is cut out. Null and empty texts stay as they are."""
    found = cut(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_items > 0"))
    docs = _without(docs, _keys(found.where("contaminated")))
    return _changed(docs, found.where("NOT contaminated"), decontaminate.without_spans)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in angle brackets. Null and empty texts stay as they are."""
    return _changed(docs, pii.find(docs).where(F.size("spans") > 0), pii.redacted)


def _changed(docs: DataFrame, found: DataFrame, new_text) -> DataFrame:
    """docs whose texts (and n_chars, where there is such a column) are new where found (doc_id, text_hash, spans) names them."""
    found = _bounded(cut(_anew(found, "doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])))
    met = docs.join(found, _same(docs, found), "left")
    hit, text = found["spans"].isNotNull(), docs["text"]
    new = F.when(hit, new_text(text, found["spans"])).otherwise(text)
    size = lambda c: F.when(hit, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(c)
    changed = {"text": lambda c: new, "n_chars": size}
    return met.select(*(changed.get(c, lambda x: x)(docs[f"`{c}`"]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The kept rows depend on hashes, automata and a tokenizer that SQL lacks; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each cut from its predecessor by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
