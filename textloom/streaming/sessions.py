"""Chat sessions as keyed streaming state, and the queue that serves them.

An event is (user_id, type, role, text, system_prompt); types are hello, message, clear and
switch. A session keeps an optional leading system message and the last `most` others, and
a rolling summary from a pluggable summariser. The batch twin is chat.trimmed_history.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "user_id string, seq long, type string, role string, text string, system_prompt string"
OUT = "user_id string, n_messages int, system_prompt string, last_text string, history string, summary string"


def apply(session: dict, event: dict, most: int = 50) -> dict:
    """The session after an event. session: system (or None), history, summary (or None)."""
    kind, prompt = event["type"], event.get("system_prompt")
    if kind == "hello":
        # a prompt replaces one that is there; only a new session takes a first one
        if prompt and (session["system"] is not None or session.get("new")):
            session["system"] = prompt
    elif kind == "message":
        session["history"] = [*session["history"], [event["role"], event["text"]]][-most:]
    elif kind in ("clear", "switch"):
        session["history"], session["summary"] = [], None
        session["system"] = prompt or session["system"]
        if kind == "switch":
            session["weights"] = {}
    session["new"] = False
    return session


def fresh() -> dict:
    return {"system": None, "history": [], "summary": None, "new": True}


def sessions(events: DataFrame, most: int = 50, summarise: Callable[[str | None, list], str] | None = None, threshold: int = 10, keep: int = 6, timeout_ms: int | None = None) -> DataFrame:
    """A stream of sessions' states after each batch of their events. With timeout_ms, idle sessions go."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = json.loads(state.get[0]) if state.exists else fresh()
        for event in sorted((r for pdf in batches for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
            session = apply(session, event, most)
        if summarise and len(session["history"]) > threshold:
            try:
                session["summary"] = summarise(session["summary"], session["history"][:-keep])
            except Exception:  # the summariser is foreign code; the plain history serves instead
                session["summary"] = session["summary"]
        state.update((json.dumps(session),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        h = session["history"]
        yield pd.DataFrame([(key[0], len(h), session["system"], h[-1][1] if h else None, json.dumps(h, ensure_ascii=False), session["summary"])], columns=[c.split()[0] for c in OUT.split(", ")])

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("user_id").applyInPandasWithState(step, OUT, "session string", "update", kind)


class Fifo:
    """A queue with so many slots: positions are told on every change; waiting entries can be withdrawn, running ones stopped."""

    def __init__(self, slots: int = 2):
        self.slots, self.waiting, self.running = slots, [], []

    def put(self, entry: str) -> list[tuple[str, int]]:
        self.waiting.append(entry)
        return self._fill()

    def done(self, entry: str) -> list[tuple[str, int]]:
        self.running = [e for e in self.running if e != entry]
        self.waiting = [e for e in self.waiting if e != entry]
        return self._fill()

    cancel = done

    def _fill(self) -> list[tuple[str, int]]:
        while self.waiting and len(self.running) < self.slots:
            self.running.append(self.waiting.pop(0))
        return [*((e, 0) for e in self.running), *((e, k + 1) for k, e in enumerate(self.waiting))]

    def __len__(self) -> int:
        return len(self.waiting) + len(self.running)


def queue_states(events: DataFrame, slots: int = 2) -> DataFrame:
    """user-visible positions of a queue's entries after each batch: queue, entry, position. Events: queue, seq, type (put, done, cancel), entry."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q = Fifo(slots)
        if state.exists:
            q.waiting, q.running = json.loads(state.get[0])
        told: list[tuple[str, int]] = []
        for e in sorted((r for pdf in batches for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
            told = (q.put if e["type"] == "put" else q.done)(e["entry"])
        state.update((json.dumps([q.waiting, q.running]),))
        yield pd.DataFrame([(key[0], e, p) for e, p in told], columns=["queue", "entry", "position"])

    return events.groupBy("queue").applyInPandasWithState(step, "queue string, entry string, position int", "state string", "update", GroupStateTimeout.NoTimeout)


LIFE = "user_id string, request string, type string, text string"
TIMEOUT_MS = 300_000


def live(running: list | None, event: dict) -> tuple[list | None, list[tuple]]:
    """What runs after an event, [request, tokens so far], and the rows (request, type, text) that are sent.

    A chat ends what runs before it starts; abort and close end it; tokens and ends of any
    other request are late and pass unheard. What is cut short is done with an empty text.
    """
    kind, request, text = event["type"], event.get("request"), event.get("text") or ""
    ended = [(running[0], "done", "")] if running else []
    if kind == "chat":
        return [request, ""], [*ended, (request, "status", "running")]
    if kind in ("abort", "close"):
        return None, ended
    if not running or request != running[0]:
        return running, []
    if kind == "token":
        return [request, running[1] + text], [(request, "token", text)]
    if kind in ("done", "error"):
        return None, [(request, kind, running[1] if kind == "done" else text)]
    return running, []


def lifecycles(events: DataFrame, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """A stream of what users are told: user_id, request, type (status, token, done, error), text.

    Events: user_id, seq, type (chat, token, done, error, abort, close), request, text. A request of
    which nothing is heard for timeout_ms ends with the error "timeout".
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            rows = [(running[0], "error", "timeout")] if running else []
        else:
            rows = []
            for event in sorted((r for pdf in batches for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
                running, told = live(running, event)
                rows += told
            state.update((json.dumps(running),))
            if running:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in LIFE.split(", ")])

    return events.groupBy("user_id").applyInPandasWithState(step, LIFE, "running string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def answers(messages: DataFrame) -> DataFrame:
    """The immediate answers to client_messages: session to hello (with a new id where there is none), cleared to clear, error to what can't be read."""
    kind = F.create_map(*(F.lit(x) for x in ("hello", "session", "clear", "cleared", "error", "error")))
    told = messages.withColumn("type", F.try_element_at(kind, "type")).where(F.col("type").isNotNull())
    user = F.when(F.col("type") == "session", F.coalesce("userId", F.uuid())).otherwise(F.col("userId"))
    return told.select("type", user.alias("userId"), F.when(F.col("type") == "error", "invalid json").alias("text"))


def token_events(lines: DataFrame, key: str = "request", line: str = "line") -> DataFrame:
    """A stream of event-stream lines as (key, type, content): token rows, and done at the end mark."""
    body = F.when(F.col(line).startswith("data: "), F.substring(F.col(line), 7, 2**31 - 1))
    token = F.get_json_object(body, "$.choices[0].delta.content")
    kind = F.when(body == "[DONE]", "done").when(F.length(token) > 0, "token")
    return lines.select(key, kind.alias("type"), token.alias("content")).where("type IS NOT NULL")


def client_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Parsed client messages with `type`; unreadable ones have type error, unknown types go."""
    schema = "type string, userId string, systemPrompt string, text string, adapterWeights map<string,double>"
    got = raw.select(F.from_json(column, schema).alias("m"))
    kind = F.coalesce("m.type", F.lit("error"))
    return got.select(kind.alias("type"), "m.userId", "m.systemPrompt", "m.text", "m.adapterWeights").where(F.col("type").isin("hello", "clear", "abort", "chat", "error"))
