"""Chat histories as tables: trimming, context windows, records, token streams, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table
from . import records


def trimmed_history(messages: DataFrame, key: str, turn: str, role: str, most: int = 50) -> DataFrame:
    """The last `most` messages of each conversation and a system message that opens it."""
    w = Window.partitionBy(key)
    first = F.min(turn).over(w)
    pinned = (F.col(role) == "system") & (F.col(turn) == first)
    ranked = messages.withColumn("_pinned", pinned)
    ranked = ranked.withColumn("_back", F.sum(F.when(F.col("_pinned"), 0).otherwise(1)).over(w.orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("_pinned") | (F.col("_back") <= most)).drop("_pinned", "_back")


def context_windows(messages: DataFrame, key: str, turn: str, role: str, text: str, threshold: int = 10, keep: int = 6, shown: int = 500) -> DataFrame:
    """key, n_messages, to_summarise (text of the older messages, null up to the threshold), recent (kept word for word)."""
    chat = messages.where(F.col(role) != "system")
    got = chat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x")))).alias("m"))
    n = F.size("m")
    line = lambda m: F.concat(m["r"], F.lit(": "), F.left(m["x"], F.lit(shown)))
    old = F.slice("m", F.lit(1), F.greatest(n - keep, F.lit(0)))
    return got.select(
        key, n.cast("long").alias("n_messages"), F.when(n > threshold, F.array_join(F.transform(old, line), "\n\n")).alias("to_summarise"),
        F.transform(F.when(n > threshold, F.slice("m", F.greatest(n - keep + 1, F.lit(1)), F.lit(keep))).otherwise(F.col("m")), lambda m: F.struct(m["r"].alias("role"), m["x"].alias("content"))).alias("recent"),
    )


def with_last_user_text(messages: Column, new_text: Column) -> Column:
    """messages with the last one's content replaced if a user wrote it."""
    n = F.size(messages)
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when((i == n - 1) & (m["role"] == "user"), new_text).otherwise(m["content"]).alias("content")))


def requested_messages(messages: Column, prompt: Column) -> Column:
    """A request's messages, or its prompt as the only one."""
    return F.coalesce(messages, F.when(prompt.isNotNull(), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))))


def generate_requests(raw: DataFrame, column: str = "body") -> DataFrame:
    """raw with status (200 or 400), error, messages, weights and options of JSON request bodies; a prompt alone becomes one message."""
    schema = "adapterWeights map<string,double>, messages array<struct<role:string,content:string>>, prompt string, options struct<temperature:double,max_tokens:int,top_p:double,repeat_penalty:double,frequency_penalty:double>"
    parsed = F.from_json(F.col(column), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    got = raw.withColumn("_r", parsed)
    messages = requested_messages(F.col("_r.messages"), F.nullif(F.col("_r.prompt"), F.lit("")))
    unread = F.col(column).isNull() | F.col("_r._bad").isNotNull() | F.col("_r").isNull() | (X.trimmed(F.coalesce(F.col(column), F.lit(""))) == "")
    error = F.when(unread, "invalid json").when(messages.isNull(), "messages or prompt required")
    fine = lambda c: F.when(F.col("error").isNull(), c)
    got = got.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))
    return got.withColumn("messages", fine(messages)).withColumn("weights", fine(F.coalesce("_r.adapterWeights", F.create_map().cast("map<string,double>")))).withColumn("options", fine(F.col("_r.options"))).drop("_r")


def responses(done: DataFrame, text: str = "text", error: str = "error", weights: str = "weights", options: str = "options") -> DataFrame:
    """done with status (200, or 502 for an error) and body, the JSON that answers a request."""
    meta = F.struct(F.col(weights).alias("adapters"), F.struct(F.col(f"{options}.temperature").alias("temperature"), F.col(f"{options}.max_tokens").alias("max_tokens")).alias("options"), F.current_timestamp().alias("timestamp"))
    failed = F.col(error).isNotNull()
    body = F.when(failed, F.to_json(F.struct(F.col(error).alias("error")))).otherwise(F.to_json(F.struct(F.col(text).alias("text"), meta.alias("meta"))))
    return done.withColumn("status", F.when(failed, 502).otherwise(200)).withColumn("body", body)


def stream_tokens(lines: DataFrame, key: str, seq: str, line: str) -> DataFrame:
    """key, full_text, n_tokens of event-stream lines: other lines, the end mark and malformed JSON are passed over."""
    body = F.when(F.col(line).startswith("data: "), F.substring(F.col(line), 7, 2**31 - 1))
    token = F.get_json_object(body, "$.choices[0].delta.content")
    got = lines.select(key, seq, F.when(body != "[DONE]", token).alias("tok")).where(F.length("tok") > 0)
    return got.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("tok").alias("t")))), lambda x: x["t"]), "").alias("full_text"), F.count("*").alias("n_tokens"))


def queue_positions(waiting: DataFrame, queue: str, at: str, entry: str, slots: int = 2) -> DataFrame:
    """position of each entry in its queue: 0 for those in a slot, then 1, 2 and so on."""
    k = F.row_number().over(Window.partitionBy(queue).orderBy(at, entry))
    return waiting.withColumn("position", F.greatest(k - slots, F.lit(0)))


def _chat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def history_trim(spark: SparkSession, d: str) -> DataFrame:
    return trimmed_history(_chat(spark, d), "conv_id", "turn", "role", 3).select("conv_id", "turn", "role")


def context_window(spark: SparkSession, d: str) -> DataFrame:
    got = context_windows(_chat(spark, d), "conv_id", "turn", "role", "text", 4, 3)
    return got.select("conv_id", "n_messages", "to_summarise", F.size("recent").cast("long").alias("n_recent"), F.sha2(F.array_join(F.transform("recent", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"), 256).alias("recent_hash"))


def chat_records(spark: SparkSession, d: str) -> DataFrame:
    got = _chat(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    msgs = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    changed = with_last_user_text(msgs, F.lit("again"))
    return got.select("conv_id", F.size("m").cast("long").alias("n"), F.sha2(records.training_string(changed), 256).alias("training_hash"))


def sse_decode(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's words sent as a stream with noise in between, and read back."""
    words = _chat(spark, d).select("conv_id", F.posexplode(F.split("text", " ")).alias("p", "w"), "turn")
    data = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.concat("w", F.lit(" ")).alias("content")).alias("delta"))).alias("choices"))))
    line = F.when(F.col("p") % 7 == 3, "data: {broken").when(F.col("p") % 7 == 5, ": keep-alive").otherwise(data)
    lines = words.select("conv_id", (F.col("turn") * 100000 + F.col("p")).alias("seq"), line.alias("line"))
    return stream_tokens(lines, "conv_id", "seq", "line").select("conv_id", F.sha2("full_text", 256).alias("text_hash"), "n_tokens")


def queue_ranks(spark: SparkSession, d: str) -> DataFrame:
    got = queue_positions(table(spark, d, "events"), "user_id", "ts", "event_id", 2)
    return got.select("event_id", F.col("position").cast("long").alias("position"))


def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return _chat(spark, d).where("role <> 'system'").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_M = "list(struct_pack(r := role, x := text) ORDER BY turn)"
QUERIES = {f.__name__: f for f in (history_trim, context_window, chat_records, sse_decode, queue_ranks, role_counts)}
SQL = {
    "history_trim": """
WITH x AS (SELECT *, role = 'system' AND turn = min(turn) OVER (PARTITION BY conv_id) AS pin FROM conversations),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pin ORDER BY turn DESC) AS k FROM x)
SELECT conv_id, turn, role FROM y WHERE pin OR k <= 3""",
    "context_window": """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system')
SELECT conv_id, max(n) AS n_messages, string_agg(role || ': ' || left(text, 500), chr(10) || chr(10) ORDER BY turn) FILTER (n > 4 AND k <= n - 3) AS to_summarise,
       count(*) FILTER (n <= 4 OR k > n - 3) AS n_recent, sha256(string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (n <= 4 OR k > n - 3)) AS recent_hash FROM x GROUP BY conv_id""",
    "chat_records": """
WITH x AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, count(*) AS n, sha256(string_agg('<|im_start|>' || role || chr(10) || CASE WHEN last AND role = 'user' THEN 'again' ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS training_hash FROM x GROUP BY conv_id""",
    "sse_decode": """
WITH x AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS p FROM conversations)
SELECT conv_id, sha256(string_agg(w || ' ', '' ORDER BY turn, p)) AS text_hash, count(*) AS n_tokens FROM x WHERE p % 7 <> 3 AND p % 7 <> 5 GROUP BY conv_id""",
    "queue_ranks": "SELECT event_id, greatest(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 2, 0) AS position FROM events",
    "role_counts": "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role <> 'system' GROUP BY role",
}
