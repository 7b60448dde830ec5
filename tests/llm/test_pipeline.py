import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from textloom.llm import decontaminate, language, packing, pii

from .test_ops import documents, exact_components

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def plain_phrases(text, sample):
    n, cur = 0, ""
    for ch in text:
        if cur + ch in sample:
            cur += ch
        else:
            n += 1
            cur = ""
    return n + bool(cur)


def test_stages_equal_brute_force(spark):
    """Each stage on what its predecessor kept, against plain loops."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 3000")
    extra = [(9001, "²½ 12"), (9002, None), (9003, ""), (9004, "write to joe@x.org now")]
    docs = docs.unionByName(spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in extra], docs.schema))
    cols, before = docs.columns, rows_of(docs)

    def ran(stage):
        nonlocal docs
        docs = P.cut(stage(spark, docs, FOLDER))
        assert docs.columns == cols and docs.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
        return rows_of(docs)

    samples = language.samples_of(docs)
    after = ran(P.language_id)
    for (k, t), n in before.items():
        plain = language.folded(t or "")
        counts = sorted(plain_phrases(plain, s) for s in samples.values())
        bad = not plain or (len(plain) >= P.UNSURE_LETTERS and 1 - counts[0] / max(counts[1], 1) < P.UNSURE)
        assert after[k, t] == (0 if bad else n)
    before = sorted(after)
    after = ran(P.near_duplicates)
    _, comp = exact_components([t for _, t in before], 5)
    assert after == Counter(before[i] for i, c in enumerate(comp) if c == i)
    before = after
    items = [re.findall("[a-z0-9\x80-\U0010ffff]+", r.text.translate({c: c + 32 for c in range(65, 91)})) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    spans_of = {r.doc_id: r for r in decontaminate.contamination(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    after = ran(P.decontamination)
    for k, t in before:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
        grams = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in {min(8, len(b)) for b in items if b}}
        n = sum(any(tuple(b[i : i + min(8, len(b))]) in grams[min(8, len(b))] for i in range(len(b) - min(8, len(b)) + 1)) for b in items if b)
        assert spans_of[k].n_items == n
        assert after[k, t] == (n == 0) and (k in {a for a, _ in after}) == (n < 2)
    before = after
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    after = {k: t for k, t in ran(P.personal_data)}
    for k, t in before:
        out, at = "", 0
        for s in found[k]:
            if s.start >= at:
                out += t[at : s.start] + f"<{s.kind}>"
            at = max(at, s.end)
        assert after[k] == out + t[at:]
    assert after[9004] == "write to <email> now" and "<email>" in "".join(after.values())
    pieces = P.packed(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert all(sum(r.length for r in pieces if r.doc_id == k) == next(r.doc_tokens for r in pieces if r.doc_id == k) for k in after)
    assert max(Counter({q: sum(r.length for r in pieces if r.sequence_id == q) for q in {r.sequence_id for r in pieces}}).values()) <= packing.WINDOW


CLASHES = ["__h", "__id", "__g", "__spans", "spans", "text_hash", "h", "kept", "lang_pred", "score", "count", "part", "hub"]


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_take_odd_rows_and_clashing_columns(spark, rows):
    texts = [None, "", "12 34", "a real sentence", "a real sentence", "mail a@b.org"] + ["x"] * 3
    odd = documents(spark, texts).drop("score", "node")
    odd = odd.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.where("doc_id = 3"))
    for c in CLASHES:
        odd = odd.withColumn(c, F.lit(7))
    docs = odd if rows == "odd" else odd.limit(0)
    cols = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, FOLDER))
        assert docs.columns == cols and docs.where("spans <> 7 OR __h <> 7").count() == 0
    got = rows_of(docs)
    want = Counter({(3, "a real sentence"): 1, (5, "mail <email>"): 1, (6, "x"): 1, (None, "a real sentence"): 1, (None, "mail <email>"): 1, (None, "x"): 1})
    assert got == (want if rows == "odd" else Counter())
    P.packed(spark, docs, FOLDER).count()


def test_near_duplicates_keep_every_other_text(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(0, a), (1, a), (1, b), (None, a), (None, a), (None, b), (4, b + " "), (5, ""), (5, ""), (6, None)], "doc_id long, text string")
    assert rows_of(P.near_duplicates(spark, docs, FOLDER)) == Counter([(0, a), (1, b), (None, a), (None, b), (5, ""), (6, None)])
    unique = docs.where("doc_id IS NULL").dropDuplicates()
    assert rows_of(P.near_duplicates(spark, unique, FOLDER)) == Counter([(None, a), (None, b)])


def test_findings_too_large_to_broadcast_change_nothing(spark, monkeypatch):
    docs = documents(spark, ["mail a@b.org", "12", "a real sentence", "a real sentence"]).drop("score", "node")
    for most in (P.SENT_MOST, 0):
        monkeypatch.setattr(P, "SENT_MOST", most)
        out = docs
        for _, stage in P.STAGES[:-1]:
            out = P.cut(stage(spark, out, FOLDER))
        assert rows_of(out) == Counter([(0, "mail <email>"), (2, "a real sentence")])


def test_language_drops_the_rejected_text_of_an_id_alone(spark):
    docs = documents(spark, [None, "12 34", "a real sentence", "another one"] * 2)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") >= 4, F.lit(7)))
    left = P.language_id(spark, docs, FOLDER).select("doc_id", "text").collect()
    assert {(r.doc_id, r.text) for r in left} == {(i, t) for i in (None, 7) for t in ("a real sentence", "another one")} and len(left) == 4


def test_run(spark):
    assert P.run(spark, FOLDER).count() > 100
