import json
import random
import time

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import analyze, chat, mixing, preference, records, validate
from textloom.plans import corpus, external
from textloom.sources import markup, readers
from textloom.streaming import sessions


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column).collect()]


def test_words_know_every_space(spark):
    texts = ["a b　c\x1cd\x85e  f", "", "  ", " x"]
    assert one(spark, X.words(F.col("t")), *texts) == [t.split() for t in texts]
    assert one(spark, X.word_count(F.col("t")), *texts) == [len(t.split()) for t in texts]


def test_quoted_chars_follow_the_state_machine(spark):
    def machine(t):
        inside = n = 0
        for c in t:
            if c == "«":
                inside = 1
            elif c == "»":
                inside = 0
            else:
                n += inside
        return n

    rng = random.Random(1)
    texts = ["".join(rng.choice("a«» \n") for _ in range(rng.randrange(20))) for _ in range(300)]
    assert one(spark, X.quoted_chars(F.col("t")), *texts) == [machine(t) for t in texts]
    assert one(spark, X.quoted_chars(F.col("t"), '"', '"'), 'a "bc" d "e', '""', "x") == [3, 0, 0]


def test_diversity_windows(spark):
    def model(w, k=3):
        if len(w) < k:
            return len(set(w)) / len(w) if w else 0.0
        parts = [len(set(w[i : i + k])) / k for i in range(0, len(w) - k + 1, k)]
        return sum(parts) / len(parts)

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 20)]
    got = one(spark, analyze.diversity(X.plain_words(F.col("t")), 3)["ttr"], *texts)
    assert all(abs(a - model(t.split())) < 1e-12 for a, t in zip(got, texts, strict=True))


def test_passages_follow_the_rule(spark):
    def model(text, least, most):
        out, parts, n = [], [], 0
        for p in filter(None, (x.strip() for x in text.replace(X.CHAPTER, "\n\n").split("\n\n"))):
            parts.append(p)
            n += len(p.split())
            if n >= least and (n >= most or len(parts) >= 5):
                out.append("\n\n".join(parts))
                parts, n = [], 0
        if parts and out and n < least // 2:
            out[-1] += "\n\n" + "\n\n".join(parts)
        elif parts:
            out.append("\n\n".join(parts))
        return out

    rng = random.Random(3)
    texts = ["\n\n".join(" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(15))) for _ in range(120)] + [f"a b c{X.CHAPTER}d e f"]
    assert one(spark, records.passages(F.col("t"), 10, 20), *texts) == [model(t, 10, 20) for t in texts]


def test_chunks_overlap_and_cut_long_paragraphs():
    count = lambda t: len(t.split())
    assert records.chunk("a b\n\nc d\n\ne f", count, 4, 2) == ["a b\n\nc d", "c d\n\ne f"]
    assert records.chunk("a. b. c. d. e. f.", count, 4, 1) == ["a. b. c. d.", "d. e. f."]
    assert records.chunk(f"a b{X.CHAPTER}c d{X.CHAPTER}  ", count, 9, 2) == ["a b", "c d"]
    assert records.chunk("", count, 4, 1) == []


def test_reasons_come_in_order(spark):
    word = "w "
    texts = ["", "  \n", word * 49, word * 50, word * 3000, word * 3001, word * 60 + "????", word * 60 + "\x00", "????"]
    assert one(spark, validate.reason(F.col("t")), *texts) == ["empty", "empty", "too_short", None, None, "too_long", "encoding", "encoding", "too_short"]


def test_survivors_scan_greedily_and_chains_do_not_collapse(spark):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    lengths = spark.createDataFrame([(1, 9), (2, 8), (3, 7), (5, 1), (6, 2)], "id long, n int")
    got = {r.id: r.dropped for r in validate.survivors(pairs, lengths).collect()}
    assert got == {1: False, 2: True, 3: False, 5: True, 6: False}


def test_hash_sample_takes_exactly_the_least(spark):
    rows = spark.range(500).withColumn("k", F.sha2(F.col("id").cast("string"), 256))
    got = {r.id for r in validate.hash_sample(rows, F.col("k"), lambda n: 37).where("taken").collect()}
    assert got == {r.id for r in rows.orderBy("k").limit(37).collect()}
    assert validate.hash_sample(rows.limit(1), F.col("k"), lambda n: 1).where("taken").count() == 1
    assert validate.hash_sample(rows.limit(0), F.col("k"), lambda n: 0).count() == 0


def test_preference_ties(spark):
    rows = [("p", i, f"t{i}", a, s) for i, (a, s) in enumerate([(5, 5), (8, 5), (5, 8), (4, 4), (4, 4)])] + [("q", 0, "x", 5, 5), ("q", 1, "y", 5, 5), ("r", 0, "z", 9, 9)]
    got = preference.preference_pairs(spark.createDataFrame(rows, "prompt string, i int, text string, a int, s int"), ["prompt"], "i", "text", "a", "s").collect()
    assert [(r.prompt, r.chosen, r.rejected, r.score_gap) for r in got] == [("p", "t1", "t4", 5)]


def test_recipes_drop_foreign_adapters(spark):
    a = mixing.adapters(spark)
    mixes = spark.createDataFrame([(1, {"a1": 1.0, "b1": 0.5, "zz": 0.5, "a2": 0.0}), (2, {"a1": 0.0})], "u int, w map<string,double>")
    (r,) = mixing.recipes(mixes, a, "u", "w").collect()
    assert (r.prompt_lang, r.backend_lang, [tuple(x) for x in r.lora]) == ("ru", "en", [(0, 0.5)])
    assert r.mix == "zz 25% + North 25% + First 50%"


def test_trim_equals_one_by_one(spark):
    rows = [("a", 0, "system", "s")] + [("a", k, "user", str(k)) for k in range(1, 9)] + [("b", k, "user", str(k)) for k in range(3)]
    df = spark.createDataFrame(rows, "c string, t int, role string, x string")
    got = {(r.c, r.t) for r in chat.trimmed_history(df, "c", "t", "role", 3).collect()}
    assert got == {("a", 0), ("a", 6), ("a", 7), ("a", 8), ("b", 0), ("b", 1), ("b", 2)}


def test_session_rules():
    s = sessions.apply(sessions.fresh(), {"type": "hello", "system_prompt": "p"})
    for k in range(4):
        s = sessions.apply(s, {"type": "message", "role": "user", "text": str(k)}, 3)
    assert (s["system"], [m[1] for m in s["history"]]) == ("p", ["1", "2", "3"])
    s = sessions.apply(s, {"type": "clear"})
    assert (s["system"], s["history"]) == ("p", [])
    q = sessions.Fifo(1)
    q.put("a")
    assert q.put("b") == [("a", 0), ("b", 1)]
    assert q.cancel("a") == [("b", 0)] and len(q) == 1


FB2 = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0">
<description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T:1</book-title><date>1999</date></title-info></description>
<body><title><p>Name</p></title><section><title><p>One</p></title><p>First <emphasis>in <strong>deep</strong></emphasis> x<a>9</a>.</p><empty-line/>
<poem><stanza><v>v1</v><v>v2</v></stanza><text-author>Me</text-author></poem><cite><p>said</p></cite><table><tr/></table></section><section><p>Two.</p></section></body>
<body name="notes"><section><p>note</p></section></body></FictionBook>"""


def test_fictionbook(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "2001 x.fb2").write_text(FB2, encoding="utf-8")
    (tmp_path / "bad.fb2").write_text("<a>", encoding="utf-8")
    (tmp_path / "blank.fb2").write_text("<FictionBook><body/></FictionBook>", encoding="utf-8")
    rows = {r.path.rpartition("/")[2]: r for r in markup.read_fb2(spark, str(tmp_path)).collect()}
    good = rows["2001 x.fb2"]
    assert (good.title, good.author, good.year) == ("T:1", "A B", "1999")
    assert "First in deep x." in good.text and "note" not in good.text and good.text.count(X.CHAPTER) == 1 and "v1\nv2\n" in good.text and "— Me" in good.text
    assert rows["bad.fb2"].error and rows["blank.fb2"].error == "no text"
    assert "First in  x." in markup.Book(FB2.encode(), keep_nested=False).text()
    named = readers.manifest(markup.read_fb2(spark, str(tmp_path)).where("error IS NULL")).collect()
    assert named[0].filename == "T1.txt" and named[0].token_count_estimate == 2 * named[0].word_count


def test_epub(spark, tmp_path):
    import zipfile

    page = "<html><body><script>no</script><p>" + "word " * 25 + "</p></body></html>"
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("x/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("x/a.xhtml", page.replace("word", "late"))
        z.writestr("x/b.xhtml", page)
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    rows = {r.path.rpartition("/")[2]: r for r in markup.read_epub(spark, str(tmp_path)).collect()}
    assert rows["a.epub"].text.split() == ["word"] * 25 + ["late"] * 25 and rows["bad.epub"].error


def test_printed_pages(spark):
    pages = [("d", 0, "skip"), ("d", 1, "Head\nabc-\ndef  \n12\n"), ("d", 2, "END here"), ("e", 1, "\n")]
    got = {r.doc: r.text for r in markup.pages_to_text(spark.createDataFrame(pages, "doc string, page_no int, text string"), skip_pages=1, running=["Head"]).collect()}
    assert got == {"d": "abcdef\n\nEND here"}


def test_html_depth_and_entities(spark):
    html = "<nav><nav>x</nav>y</nav><p>a&amp;b<br>c</p>"
    assert markup.page_text(html).split() == ["a&b", "c"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n\n{bad\n{"text": "b"}\n')
    got = readers.read_jsonl_permissive(spark, str(tmp_path / "x.jsonl"), "text string").orderBy("line_no").collect()
    assert [(r.line_no, r.record.text, r.is_bad) for r in got] == [(1, "a", False), (3, None, True), (4, "b", False)]
    readers.write_jsonl(spark.createDataFrame([("é",)], "text string"), str(tmp_path / "out"))
    assert [r.text for r in readers.read_jsonl(spark, str(tmp_path / "out"), "text string").collect()] == ["é"]


def test_external_models(spark):
    prompts = spark.createDataFrame([("p", "t", "c")], "prompt string, type string, constraint string")

    def flaky(request):
        if request["temperature"] > 0.9:
            raise ValueError
        return external.stub_completion(request)

    done = external.completions(prompts, [0.5, 1.0, 0.7], flaky, tries=2, pause=0.0)
    assert [(c["index"], c.text) for c in done.first().completions] == [(0, "p [0.50]"), (2, "p [0.70]")]
    scores = external.scored(done, pause=0.0).collect()
    assert all(r.total == r.adherence + r.style for r in scores) and len(scores) == 2
    broken = external.scored(done, lambda r: 1 / 0, tries=1).collect()
    assert {r.total for r in broken} == {10}
    assert external.healthy({"a": lambda: True}) and not external.healthy({"a": lambda: 1 / 0}) and not external.healthy({})


def test_corpus_pipeline_of_books(spark, tmp_path):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    books = tmp_path / "books"
    books.mkdir()
    for k in range(4):
        words = " ".join(f"w{k}x{i}" for i in range(130))
        (books / f"b{k}.fb2").write_text(FB2.replace("Two.", f"{words}. {words} end."), encoding="utf-8")
    (books / "copy.fb2").write_text((books / "b0.fb2").read_text(encoding="utf-8"), encoding="utf-8")
    got = corpus.run_pipeline(spark, corpus.Config(str(books), str(tmp_path / "out"), chunk_size=400, overlap=50, least_words=100, most_words=150))
    assert got["totals"].first().total_files == 5
    train, held = got["train"].count(), got["eval"].count()
    assert held == 1 and train > 3
    assert validate.overlap(got["train"], got["eval"]).count() == 0
    assert json.loads(got["report"].toJSON().first())["parsed_input"] > 0


def test_every_passage_has_an_instruction_record(spark):
    folder = "/root/testdata/sf0.01"
    want = {(r.doc_id, r.passage_idx) for r in records.passages_60_120(spark, folder).collect()}
    assert max(k for _, k in want) > 0
    assert {(r.doc_id, r.passage_idx) for r in records.QUERIES["instruction_records_all"](spark, folder).collect()} == want


def test_equal_contents_stay_on_one_side(spark):
    rows = spark.createDataFrame([(k, f"t{k % 37 if k % 3 else 0}") for k in range(600)], "doc_id long, text string")
    for ratio in (0.01, 0.2, 0.5, 0.9):
        got = validate.split(rows, ratio)
        sides = got.groupBy("text").agg(F.count_distinct("is_eval").alias("n")).agg(F.max("n")).first()[0]
        assert sides == 1 and got.count() == 600
        assert validate.overlap(got.where("is_eval"), got.where("NOT is_eval")).count() == 0
        assert got.where("is_eval").count() >= int(600 * ratio)


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(8):
        base = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(60)]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(60)] = f"x{rng.randrange(99)}"
            texts.append(" ".join([*w, "all rights reserved by the authors"]))
    texts += texts[:3] + ["a b", "", "all rights reserved by the authors"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {}
    for k, t in enumerate(texts):
        w = t.split()
        if t not in texts[:k] and len(w) >= 3:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    for limit in (0.5, 0.7, 0.85):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
        want = {p: j for p, j in want.items() if j >= limit}
        got = {(r.a, r.b): r.jaccard for r in validate.similar_pairs(df, limit).collect()}
        assert got == want
    links = [(k, k + 1) for k in range(0, 40) if k % 9] + [(50, 41)]
    label = {r.id: r.c for r in validate.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert label[50] == 41 and label[9] == 1 and label[18] == 10 and label[40] == 37


def test_reports_and_requests(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", "One two. Three?"), ("b.txt", "Word " * 1500)], "filename string, text string")
    stats = analyze.document_stats(docs, "filename", least_words=1000)
    text = analyze.report_text(stats).first().report
    assert text.index("b.txt") < text.index("a.txt") and "Words: 1,503" in text and text.endswith("Flagged\na.txt: suspiciously_short")
    readers.write_json(analyze.stats_record(stats), str(tmp_path / "stats"))
    read = spark.read.json(str(tmp_path / "stats")).first()
    assert read.aggregate.total_files == 2 and [f.filename for f in read["files"]] == ["b.txt", "a.txt"]
    counts = validate.validation_counts(docs.select("text")).withColumn("input_file", F.lit("x.jsonl"))
    assert validate.validation_text(counts).first().report.endswith("Removed in all: 1\nKept in all: 1")
    bodies = ['{"prompt": "p"}', "{bad", '{"options": {"temperature": 0.5}}', '{"messages": [{"role": "user", "content": "c"}], "prompt": "p", "adapterWeights": {"a": 1.5}}', None, '{"prompt": ""}']
    got = chat.generate_requests(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r.status, r.error) for r in got] == [(200, None), (400, "invalid json"), (400, "messages or prompt required"), (200, None), (400, "invalid json"), (400, "messages or prompt required")]
    assert got[0].messages[0].content == "p" and got[3].messages[0].content == "c" and got[3].weights == {"a": 1.5}
    done = spark.createDataFrame([("t", None, {"a": 1.0}, (0.5, 9)), (None, "timeout", None, None)], "text string, error string, weights map<string,double>, options struct<temperature:double,max_tokens:int>")
    bodies = [(r.status, json.loads(r.body)) for r in chat.responses(done).collect()]
    assert bodies[0][0] == 200 and bodies[0][1]["meta"]["options"] == {"temperature": 0.5, "max_tokens": 9} and bodies[1] == (502, {"error": "timeout"})


def test_small_functions(spark):
    assert one(spark, X.collapsed(F.col("t")), "a\n\n\n\nb\n\nc") == ["a\n\nb\n\nc"] and one(spark, X.slug(F.col("t")), "A – b: c!") == ["A  b c"]
    assert one(spark, records.closed_text(F.col("t")), "x") == ["x</s>"]
    row = spark.createDataFrame([(None, [("user", "u"), ("assistant", "s")]), ("t", None), (None, None)], "text string, m array<struct<role:string,content:string>>")
    assert [r[0] for r in row.select(X.record_text(F.col("text"), F.col("m"))).collect()] == ["s", "t", ""]
    asked = spark.createDataFrame([("p", None), (None, None), ("p", [("user", "m")])], "prompt string, m array<struct<role:string,content:string>>")
    got = [r[0] for r in asked.select(chat.requested_messages(F.col("m"), F.col("prompt"))).collect()]
    assert [x and x[0].content for x in got] == ["p", None, "m"]
    assert one(spark, markup.epub_name(F.col("t")), "x")[0] is not None
    sets = spark.createDataFrame([("p", [("a", 1), ("b", 2)])], "prompt string, completions array<struct<text:string,index:int>>")
    assert [tuple(r) for r in preference.exploded(sets, ["prompt"]).collect()] == [("p", 0, "a", 1), ("p", 1, "b", 2)]
    authors = spark.createDataFrame([("a", "A", {"t": "u"}), ("b", "B", {"v": "w", "x": "y"})], "author string, label string, works map<string,string>")
    assert readers.works_of(authors).count() == 3 and [r.title for r in readers.works_of(authors, "a").collect()] == ["t"]
    page = {"u": b"caf\xe9 one"}
    works = readers.works_of(authors, "a")
    assert [readers.fetched(works, "url", page.get, otherwise=o).first().text for o in ("latin-1", "replace")] == ["café one", "caf\ufffd one"]
    adapters = mixing.adapter_rows(spark.createDataFrame([("a:A,b", "en"), ("c", "ru")], "raw string, lang string"))
    assert {r.lang for r in mixing.languages(adapters).collect()} == {"en", "ru"}
    prompts = spark.createDataFrame([("p", "t"), ("q", "t")], "prompt string, type string")

    def half(request):
        if request["prompt"] == "q":
            raise ValueError("no model")
        return " done "

    told = external.evaluated(prompts, half)
    assert {r.prompt: r.text for r in told.collect()} == {"p": "done", "q": "[ERROR: no model]"}
    html = preference.evaluation_page(told.withColumn("id", F.when(F.col("prompt") == "p", 1).otherwise(2))).first().html
    assert html.index("done") < html.index("no model") and html.startswith("<!doctype html>")


def test_chunks_by_a_real_tokenizer(spark):
    import public_tokenizers

    count = records.TokenizerCount(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(1, "\n\n".join(f"Sentence number {k} is here." for k in range(40))), (2, None)], "doc_id long, text string")
    got = records.token_chunks(docs, 64, 16, count).orderBy("chunk_idx").collect()
    assert len(got) > 3 and all(r.n_tokens == count(r.text) <= 64 for r in got)


def test_chunks_come_in_small_batches():
    import pyarrow as pa

    asked = []

    def count(t):
        asked.append(t)
        return len(t.split())

    text = "\n".join(f"number {k} of the lines" for k in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([text] * 999 + [None])], names=["doc_id", "text"])
    sizes, rows = [], 0
    for ids, places, chunks, tokens in records.chunk_rows(iter([batch]), count, 100, 10, "\n"):
        sizes.append(sum(map(len, chunks)))
        assert len(ids) == len(places) == len(chunks) == len(tokens)
        if len(sizes) == 1:  # the first leave before most texts have been looked at
            assert len(asked) < 400 * 300
        rows += len(ids)
    one = records.chunk(text, count, 100, 10, "\n")
    assert rows == 999 * len(one) and max(sizes) < records.HELD + 1000 and len(sizes) > 5


def shuffled(spark, run):
    """Bytes that the shuffles of run() have written."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()

    def all_stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(got.apply(k).shuffleWriteBytes() for k in range(got.size()))

    before = all_stages()
    run()
    return all_stages() - before


def similar_texts(rng, families, members, words):
    texts = []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(members):
            w = list(base)
            for _ in range(words // 40):
                w[rng.randrange(words)] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(w))
    return texts


def test_similar_pairs_send_about_as_much_as_the_texts(spark):
    """Each shingle once, in few bytes, and each set of a family once, not for each of its pairs."""
    texts = similar_texts(random.Random(5), 3, 100, 400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    found, most = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        sent = shuffled(spark, lambda: found.append(validate.similar_pairs(df, 0.7).count()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    times = sent / sum(map(len, texts))
    assert found == [14850] and times < 8, times


def test_similar_pairs_by_small_chunks_ranges_and_blocks(spark, monkeypatch):
    from textloom.operators import prefix

    monkeypatch.setattr(prefix, "CHUNK", 300)
    monkeypatch.setattr(prefix, "RANGE_OCTETS", 500)
    monkeypatch.setattr(validate, "BLOCK", 3)
    monkeypatch.setattr(validate, "BLOCK_ITEMS", 200)
    texts = [*similar_texts(random.Random(6), 4, 14, 80), None, "", "a b", "One two three", "one TWO three", "one two three"]
    df = spark.createDataFrame([(k * 3, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = {k * 3: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in enumerate(texts) if len(w := (t or "").lower().split()) > 2}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    for limit in (0.7, 0.85):
        for most in (0, validate.MOST_IDS):  # ids that are joined, and such that are sent to all
            monkeypatch.setattr(validate, "MOST_IDS", most)
            assert {(r.a, r.b): r.jaccard for r in validate.similar_pairs(df, limit).collect()} == {p: j for p, j in want.items() if j >= limit}


def test_signatures_equal_plain_loops(spark):
    import hashlib

    from textloom.functions.shingles import PRIME, minhash_of

    def plain(t, perms):
        w = t.split()
        h = {int(hashlib.md5(" ".join(w[i : i + 3]).encode()).hexdigest()[:7], 16) for i in range(len(w) - 2)}
        return [min((x * (k * 7919 + 12345) + k * 104729) % PRIME for x in h) for k in range(1, perms + 1)]

    rng = random.Random(7)
    texts = similar_texts(rng, 6, 3, 200) + ["a b c", "é ß ñ ω"]
    assert all(minhash_of(t, 3, 128).tolist() == plain(t, 128) for t in texts) and minhash_of("a b", 3, 128) is None
    df = spark.createDataFrame([*enumerate([*texts, texts[0], "a b", None])], "doc_id long, text string")
    m = [plain(t, 8) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if any(m[a][k : k + 2] == m[b][k : k + 2] for k in (0, 2, 4, 6))}
    assert {(r.a, r.b) for r in validate.lsh_pairs(df, 4, 2).collect()} == want and want


# --- streams ---


def stream(spark, folder, rows, schema):
    """A stream of one file a batch, in order."""
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(folder / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))


def ran(spark, df, folder, mode, rows):
    """(batch, *row) until so many rows have come: with timeouts a query never comes to its end."""
    out = []

    def keep(batch, number):
        out.extend((number, *r) for r in batch.collect())

    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(folder / "state")).foreachBatch(keep).start()
    end = time.time() + 60
    while len(out) < rows and time.time() < end and query.isActive:
        time.sleep(0.2)
    query.stop()
    return out


def test_queue_states(spark, tmp_path):
    events = stream(spark, tmp_path, [[("q", 1, "put", "a"), ("q", 2, "put", "b"), ("q", 3, "put", "c"), ("q", 4, "put", "d")], [("q", 5, "cancel", "c")], [("q", 6, "done", "a"), ("r", 1, "put", "z")]], "queue string, seq long, type string, entry string")
    got = ran(spark, sessions.queue_states(events, 2), tmp_path, "update", 10)
    last = max(n for n, *_ in got)
    assert {r[1:] for r in got if r[0] == last} == {("q", "b", 0), ("q", "d", 0), ("r", "z", 0)}
    assert {r[1:] for r in got if r[0] == 0} == {("q", "a", 0), ("q", "b", 0), ("q", "c", 1), ("q", "d", 2)}


def test_lifecycles(spark, tmp_path):
    rows = [[("u", 1, "chat", "r1", None), ("u", 2, "token", "r1", "a")], [("u", 3, "token", "r1", "b"), ("u", 4, "chat", "r2", None), ("u", 5, "token", "r1", "late")], [("u", 6, "token", "r2", "c"), ("u", 7, "done", "r2", None), ("u", 8, "abort", None, None), ("v", 1, "chat", "r3", None), ("v", 2, "close", None, None)]]
    got = ran(spark, sessions.lifecycles(stream(spark, tmp_path, rows, "user_id string, seq long, type string, request string, text string")), tmp_path, "append", 9)
    assert [r[2:] for r in got if r[1] == "u"] == [("r1", "status", "running"), ("r1", "token", "a"), ("r1", "token", "b"), ("r1", "done", ""), ("r2", "status", "running"), ("r2", "token", "c"), ("r2", "done", "c")]
    assert [r[2:] for r in got if r[1] == "v"] == [("r3", "status", "running"), ("r3", "done", "")]
    assert sessions.live(["r", "x"], {"type": "error", "request": "r", "text": "bad"}) == (None, [("r", "error", "bad")])


def test_stream_lines_and_client_messages(spark):
    lines = spark.createDataFrame([("r", 'data: {"choices":[{"delta":{"content":"hi"}}]}'), ("r", ": ping"), ("r", "data: {broken"), ("r", "data: [DONE]")], "request string, line string")
    assert [tuple(r) for r in sessions.token_events(lines).collect()] == [("r", "token", "hi"), ("r", "done", None)]
    raw = spark.createDataFrame([('{"type":"hello","userId":"u"}',), ("{no",), ('{"type":"clear"}',), ('{"type":"other"}',), ('{"type":"hello"}',)], "value string")
    messages = sessions.client_messages(raw)
    assert [r.type for r in messages.collect()] == ["hello", "error", "clear", "hello"]
    got = [tuple(r) for r in sessions.answers(messages).collect()]
    assert [r[0] for r in got] == ["session", "error", "cleared", "session"] and got[0][1] == "u" and len(got[3][1]) == 36 and got[1][2] == "invalid json"


def test_session_stream_over_many_batches(spark, tmp_path):
    from textloom.streaming import queries as streams

    for k in range(9):
        part = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where(F.col("turn") == k)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    one_batch = streams.session_state_stream(spark, "/root/testdata/sf0.001").collect()
    many = streams.session_state_stream(spark, str(tmp_path), files_per_trigger=1).collect()
    assert sorted(map(str, many)) == sorted(map(str, one_batch)) and len(many) == len({r.conv_id for r in many})
