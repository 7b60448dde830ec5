"""From documents to training records: passages, overlapping chunks, instructions, training strings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import sql as Q
from ..sources.tables import table

#: Beginnings of words that mark reflection and action.
REFLECTION = ["смысл", "сознани", "реальност", "истин", "бытие", "пустот", "медитац", "ум", "дух", "свобод", "иллюзи", "просветлен"]
ACTION = ["побежал", "выстрелил", "ударил", "бросил", "закричал", "схватил", "упал", "взорвал", "вскочил", "ринулся"]
#: The instructions that go with them.
INSTRUCTIONS = {
    "dialogue": "Напиши сцену с диалогом, в которой персонажи обсуждают {}.",
    "no_hint": "различные темы",
    "reflection": "Напиши философское размышление о природе реальности и сознания в ироничном стиле.",
    "action": "Напиши динамичную сцену с неожиданным поворотом событий.",
    "theme": "Напиши прозаический отрывок, начинающийся с темы: «{}».",
}
#: Our own system prompts by author key, and the one for all others.
SYSTEM_PROMPTS = {"poe": "You write dark, measured tales.", "twain": "You write plain-spoken, humorous tales.", "austen": "You write of manners with irony."}
DEFAULT_SYSTEM = "You are a writer of fiction."


def passages(text: Column, least: int = 300, most: int = 800, separator: str = "\n\n") -> Column:
    """Paragraphs packed in order. A passage closes once it has `least` words and either `most` words or five
    paragraphs; a rest of under half of `least` joins the last passage."""
    paras = X.paragraphs(F.replace(text, F.lit(X.CHAPTER), F.lit(separator)), separator)

    def step(acc: Column, p: Column) -> Column:
        parts, n = F.concat(acc["parts"], F.array(p)), acc["n"] + X.word_count(p)
        full = (n >= least) & ((n >= most) | (F.size(parts) >= 5))
        done = F.when(full, F.concat(acc["done"], F.array(F.array_join(parts, separator)))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, F.array().cast("array<string>")).otherwise(parts).alias("parts"), F.when(full, 0).otherwise(n).alias("n"))

    def finish(acc: Column) -> Column:
        rest, k = F.array_join(acc["parts"], separator), F.size(acc["done"])
        glued = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(k - 1, F.lit(0))), F.array(F.concat(F.get(acc["done"], k - 1), F.lit(separator), rest)))
        return F.when(F.size(acc["parts"]) == 0, acc["done"]).when((k > 0) & (acc["n"] < least // 2), glued).otherwise(F.concat(acc["done"], F.array(rest)))

    none = F.array().cast("array<string>")
    return F.aggregate(paras, F.struct(none.alias("done"), none.alias("parts"), F.lit(0).alias("n")), step, finish)


def instruction(passage: Column, reflection: list[str] = REFLECTION, action: list[str] = ACTION, texts: dict[str, str] = INSTRUCTIONS, opening: str = "«", closing: str = "»") -> Column:
    """A heuristic instruction that the passage could answer."""
    has = lambda markers: F.lower(passage).rlike("|".join(map(re.escape, markers)))
    fill = lambda t, x: F.concat(F.lit(t.split("{}")[0]), x, F.lit(t.split("{}")[1]))
    hint = F.coalesce(F.nullif(F.regexp_extract(passage, f"{opening}([^{closing}]{{10,60}})", 1), F.lit("")), F.lit(texts["no_hint"]))
    theme = F.left(X.trimmed(F.get(F.split(passage, "[.!?…]"), F.lit(0))), F.lit(80))
    talks = (X.occurrences(passage, opening) >= 3) & F.contains(passage, F.lit(closing))
    return F.when(talks, fill(texts["dialogue"], hint)).when(has(reflection), F.lit(texts["reflection"])).when(has(action), F.lit(texts["action"])).otherwise(fill(texts["theme"], theme))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))))


def training_string(msgs: Column, opens: str = "<|im_start|>", closes: str = "<|im_end|>") -> Column:
    """The messages by a chat template with one opening and closing mark."""
    return F.array_join(F.transform(msgs, lambda m: F.concat(F.lit(opens), m["role"], F.lit("\n"), m["content"], F.lit(closes), F.lit("\n"))), "")


def closed_text(text: Column, end: str = "</s>") -> Column:
    """The training string of a continuation: the text and the end mark."""
    return F.concat(text, F.lit(end))


def estimated_tokens(text: str) -> int:
    return 2 * len(text.split())


class TokenizerCount:
    """A text's tokens by a tokenizer file, for token_chunks; each worker process opens the file once."""

    _open: dict = {}

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        if self.path not in self._open:
            from tokenizers import Tokenizer

            self._open[self.path] = Tokenizer.from_file(self.path)
        return len(self._open[self.path].encode(text, add_special_tokens=False).ids)


HELD = 1_000_000  # about the most characters of chunks that a task holds
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def chunk(text: str, count: Callable[[str], int], size: int, overlap: int, separator: str = "\n\n") -> list[str]:
    """Chunks of at most `size` tokens at paragraph ends, chapter by chapter. The next chunk begins with trailing
    pieces of up to `overlap` tokens. A longer paragraph is cut at sentence ends by the same rule."""
    out: list[str] = []

    def fill(pieces: list[tuple[str, int]], glue: str) -> None:
        held: list[tuple[str, int]] = []
        for piece, n in pieces:
            if held and sum(k for _, k in held) + n > size:
                out.append(glue.join(p for p, _ in held))
                keep = len(held)
                room = overlap
                while keep and held[keep - 1][1] <= room:
                    keep -= 1
                    room -= held[keep][1]
                held = held[keep:]
            held.append((piece, n))
        if held:
            out.append(glue.join(p for p, _ in held))

    for chapter in text.split(X.CHAPTER):
        run: list[tuple[str, int]] = []
        for para in filter(None, map(str.strip, chapter.split(separator))):
            n = count(para)
            if n > size:
                fill(run, separator)
                run = []
                fill([(s, count(s)) for s in _SENTENCE.split(para) if s.strip()], " ")
            else:
                run.append((para, n))
        fill(run, separator)
    return out


def token_chunks(docs: DataFrame, size: int = 2048, overlap: int = 256, count: Callable[[str], int] = estimated_tokens, separator: str = "\n\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_idx, text, n_tokens; `count` gives a text's tokens and may be any tokenizer's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunk_rows(batches, count, size, overlap, separator):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=[id_col, "chunk_idx", "text", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, chunk_idx int, text string, n_tokens int")


def chunk_rows(batches: Iterator[pa.RecordBatch], count: Callable[[str], int], size: int, overlap: int, separator: str) -> Iterator[tuple[list, list, list, list]]:
    """Lists of ids, places, chunks and their tokens, again and again when HELD characters of chunks have come
    together; of the texts (ids and texts in batches) one at a time is Python's."""
    rows: tuple[list, list, list, list] = ([], [], [], [])
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            for k, c in enumerate(chunk(t.as_py() or "", count, size, overlap, separator)):
                for x, v in zip(rows, (i.as_py(), k, c, count(c)), strict=True):
                    x.append(v)
                held += len(c)
                if held >= HELD:
                    yield rows
                    rows, held = ([], [], [], []), 0
    if held:
        yield rows


def system_prompt(key: Column, override: str | None = None, prompts: dict[str, str] = SYSTEM_PROMPTS, default: str = DEFAULT_SYSTEM) -> Column:
    """An explicit prompt, else the key's, else the default."""
    if override:
        return F.lit(override)
    known = F.create_map(*(F.lit(x) for kv in prompts.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(key)), F.lit(default))


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *cols)


def _passages(spark: SparkSession, d: str, least: int, most: int) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(passages(F.col("text"), least, most, "\n")).alias("passage_idx", "passage"))
    return rows.select("doc_id", F.col("passage_idx").cast("long").alias("passage_idx"), "passage")


def passages_300_800(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d, 300, 800)


def passages_60_120(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d, 60, 120)


_EN = {"dialogue": "Write a dialogue about {}.", "no_hint": "anything", "reflection": "Write a reflection.", "action": "Write an action scene.", "theme": "Write a passage that begins with: {}."}


def instruction_records_all(spark: SparkSession, d: str) -> DataFrame:
    """A record for every passage of every document."""
    rows = _docs(spark, d, "source").select("doc_id", "source", F.posexplode(passages(F.col("text"), 60, 120, "\n")).alias("passage_idx", "p"))
    told = instruction(F.col("p"), ["erentre", "keitver"], ["moron", "ciónbo"], _EN, '"', '"')
    msgs = messages(system_prompt(F.col("source"), prompts={"src1": "One.", "src2": "Two."}), told, F.col("p"))
    return rows.select("doc_id", F.col("passage_idx").cast("long").alias("passage_idx"), told.alias("instruction"), F.sha2(training_string(msgs), 256).alias("training_hash"))


def instruction_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of the documents' first passages, as its SQL has it; instruction_records_all has every passage."""
    return instruction_records_all(spark, d).where("passage_idx = 0").drop("passage_idx")


def token_chunk_list(spark: SparkSession, d: str) -> DataFrame:
    return token_chunks(_docs(spark, d), 512, 64, separator="\n").select("doc_id", "chunk_idx", "n_tokens", F.sha2("text", 256).alias("text_hash"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    got = _passages(spark, d, 300, 800).select((X.word_count(F.col("passage")) * 2).alias("n"))
    return got.agg(F.count("*").alias("total_chunks"), F.min("n").cast("long").alias("min_tokens"), F.max("n").cast("long").alias("max_tokens"), F.sum("n").alias("total_tokens"), (F.sum("n") / F.count("*")).alias("avg_tokens"))


def prompt_grid(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items dealt round-robin to ten types and constraints, each with four topics least by a seeded hash."""
    topics = F.array(*(F.lit(f"topic{k:02d}") for k in range(20)))
    i = F.col("item_id")
    drawn = F.transform(F.slice(F.array_sort(F.transform(topics, lambda t: F.struct(F.md5(F.concat_ws(":", F.lit(42), i, t)).alias("h"), t.alias("t")))), F.lit(1), F.lit(4)), lambda x: x["t"])
    return table(spark, d, "benchmark").select("item_id", F.element_at(F.array(*(F.lit(f"type{k}") for k in range(10))), (i % 10 + 1).cast("int")).alias("prompt_type"), F.array_join(drawn, ",").alias("topics"))


def prompt_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First lines as numbered prompts: unnumbered, longer than 20 characters, first of each."""
    line = X.unnumbered(F.concat(F.col("doc_id") % 9 + 1, F.lit(".) "), F.get(F.split("text", "\n"), F.lit(0))))
    rows = _docs(spark, d).select("doc_id", line.alias("prompt")).where(F.length("prompt") > 20)
    return rows.groupBy("prompt").agg(F.min("doc_id").alias("doc_id"))


def unwrap_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(X.unwrapped(F.col("text")), 256).alias("text_hash"))


def book_frame_strip(spark: SparkSession, d: str) -> DataFrame:
    framed = F.concat(F.lit("Licence\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), F.col("text"), F.lit("\nEnd of the Project Gutenberg EBook\nmore"))
    framed = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(framed)
    return _docs(spark, d).select("doc_id", F.sha2(X.without_book_frame(framed), 256).alias("text_hash"))


def completion_clean(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.when(F.col("doc_id") % 2 == 0, "Опишите это. ").otherwise("<SPECIAL_12> "), F.col("text"))
    return _docs(spark, d).select("doc_id", X.clean_completion(dirty).alias("cleaned"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.html_escaped(F.concat(F.lit("a<b & c\n"), F.col("text"))).alias("escaped"))


def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(X.dehyphenated(F.replace("text", F.lit("th"), F.lit("t-\nh"))), 256).alias("text_hash"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """One safe name a title; titles that meet get _2, _3 and so on. The window holds one title's works."""
    rows = _docs(spark, d, "source", "lang").select("doc_id", X.safe_name(F.concat(F.lit(". "), F.col("source"), F.lit('?:"'), F.col("lang"), F.lit("."))).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("doc_id"))
    return rows.select("doc_id", F.when(k == 1, F.col("base")).otherwise(F.concat_ws("_", "base", k)).alias("name"))


_PARAS = Q.paragraphs("text")


def _passage_sql(least: int, most: int) -> str:
    return f"""
p AS (SELECT doc_id, {_PARAS} AS ps FROM documents),
w AS (SELECT doc_id, ps, list_transform(ps, lambda q: len({Q.words("q")})) AS n FROM p),
f AS (SELECT doc_id, ps, n, 1 AS i, CAST([] AS VARCHAR[]) AS parts, 0 AS c, CAST([] AS VARCHAR[]) AS done FROM w
      UNION ALL
      SELECT doc_id, ps, n, i + 1,
        CASE WHEN c + n[i] >= {least} AND (c + n[i] >= {most} OR len(parts) + 1 >= 5) THEN CAST([] AS VARCHAR[]) ELSE list_append(parts, ps[i]) END,
        CASE WHEN c + n[i] >= {least} AND (c + n[i] >= {most} OR len(parts) + 1 >= 5) THEN 0 ELSE c + n[i] END,
        CASE WHEN c + n[i] >= {least} AND (c + n[i] >= {most} OR len(parts) + 1 >= 5) THEN list_append(done, array_to_string(list_append(parts, ps[i]), chr(10))) ELSE done END
      FROM f WHERE i <= len(ps)),
g AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN done WHEN len(done) > 0 AND c < {least // 2} THEN list_append(done[1:len(done) - 1], done[len(done)] || chr(10) || array_to_string(parts, chr(10)))
      ELSE list_append(done, array_to_string(parts, chr(10))) END AS out FROM f WHERE i = len(ps) + 1)"""


_PASSAGES = "WITH RECURSIVE {} SELECT doc_id, CAST(unnest(range(0, len(out))) AS BIGINT) AS passage_idx, unnest(out) AS passage FROM g"
_INSTRUCT = f"""CASE WHEN length(p) - length(replace(p, '"', '')) >= 3 THEN 'Write a dialogue about ' || coalesce(nullif(regexp_extract(p, '"([^"]{{10,60}})', 1), ''), 'anything') || '.'
 WHEN regexp_matches(lower(p), 'erentre|keitver') THEN 'Write a reflection.' WHEN regexp_matches(lower(p), 'moron|ciónbo') THEN 'Write an action scene.'
 ELSE 'Write a passage that begins with: ' || left({Q.trimmed("string_split_regex(p, '[.!?…]')[1]")}, 80) || '.' END"""
_TYPES = "['" + "', '".join(f"type{k}" for k in range(10)) + "']"
QUERIES = {
    f.__name__: f
    for f in (
        passages_300_800, passages_60_120, instruction_records, instruction_records_all, token_chunk_list, chunk_stats, prompt_grid, prompt_dedup, unwrap_lines,
        book_frame_strip, completion_clean, html_escape, dehyphenate, file_names,
    )
}
SQL = {
    "passages_300_800": _PASSAGES.format(_passage_sql(300, 800)),
    "passages_60_120": _PASSAGES.format(_passage_sql(60, 120)),
    "instruction_records": f"""
WITH RECURSIVE {_passage_sql(60, 120)},
x AS (SELECT g.doc_id, source, out[1] AS p FROM g JOIN documents d ON d.doc_id = g.doc_id WHERE len(out) > 0),
y AS (SELECT doc_id, p, CASE source WHEN 'src1' THEN 'One.' WHEN 'src2' THEN 'Two.' ELSE 'You are a writer of fiction.' END AS s, {_INSTRUCT} AS instruction FROM x)
SELECT doc_id, instruction, sha256('<|im_start|>system' || chr(10) || s || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || p || '<|im_end|>' || chr(10)) AS training_hash FROM y""",
    "instruction_records_all": f"""
WITH RECURSIVE {_passage_sql(60, 120)},
x AS (SELECT g.doc_id, source, CAST(unnest(range(0, len(out))) AS BIGINT) AS passage_idx, unnest(out) AS p FROM g JOIN documents d ON d.doc_id = g.doc_id),
y AS (SELECT doc_id, passage_idx, p, CASE source WHEN 'src1' THEN 'One.' WHEN 'src2' THEN 'Two.' ELSE 'You are a writer of fiction.' END AS s, {_INSTRUCT} AS instruction FROM x)
SELECT doc_id, passage_idx, instruction, sha256('<|im_start|>system' || chr(10) || s || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || p || '<|im_end|>' || chr(10)) AS training_hash FROM y""",
    "chunk_stats": f"""
WITH RECURSIVE {_passage_sql(300, 800)}, x AS (SELECT 2 * len({Q.words("q")}) AS n FROM (SELECT unnest(out) AS q FROM g))
SELECT count(*) AS total_chunks, CAST(min(n) AS BIGINT) AS min_tokens, CAST(max(n) AS BIGINT) AS max_tokens, CAST(sum(n) AS BIGINT) AS total_tokens, CAST(sum(n) AS DOUBLE) / count(*) AS avg_tokens FROM x""",
    "prompt_grid": f"""
WITH t AS (SELECT item_id, unnest(range(0, 20)) AS k FROM benchmark), h AS (SELECT item_id, 'topic' || lpad(CAST(k AS VARCHAR), 2, '0') AS t FROM t),
r AS (SELECT item_id, t, md5('42:' || item_id || ':' || t) AS h, row_number() OVER (PARTITION BY item_id ORDER BY md5('42:' || item_id || ':' || t)) AS r FROM h)
SELECT item_id, ({_TYPES})[item_id % 10 + 1] AS prompt_type, string_agg(t, ',' ORDER BY h) AS topics FROM r WHERE r <= 4 GROUP BY item_id""",
    "prompt_dedup": f"""
WITH x AS (SELECT doc_id, {Q.trimmed("ltrim((doc_id % 9 + 1) || '.) ' || string_split(text, chr(10))[1], '0123456789.-) ')")} AS prompt FROM documents)
SELECT prompt, min(doc_id) AS doc_id FROM x WHERE length(prompt) > 20 GROUP BY prompt""",
    "unwrap_lines": rf"""
WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(^|[^\n])\n([a-z])', '\1 \2', 'g'), '(^|[^\n])\n([a-z])', '\1 \2', 'g') AS t FROM documents)
SELECT doc_id, sha256({Q.trimmed("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")}) AS text_hash FROM x""",
    "book_frame_strip": "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE text || chr(10) END) AS text_hash FROM documents",
    "completion_clean": f"SELECT doc_id, {Q.trimmed('text')} AS cleaned FROM documents",
    "html_escape": "SELECT doc_id, 'a&lt;b &amp; c<br>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '<br>') AS escaped FROM documents",
    "dehyphenate": "SELECT doc_id, sha256(text) AS text_hash FROM documents",
    "file_names": r"""
WITH x AS (SELECT doc_id, left(trim(regexp_replace('. ' || source || '?:"' || lang || '.', '[<>:"/\\|?*]', '', 'g'), '. '), 200) AS b FROM documents),
y AS (SELECT doc_id, CASE WHEN b = '' THEN 'untitled' ELSE b END AS b FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS k FROM y)
SELECT doc_id, CASE WHEN k = 1 THEN b ELSE b || '_' || k END AS name FROM z""",
}
