"""Foreign models behind plain callables, with retries inside a task and offline doubles.

A model is a function of one request (a dict) that returns a reply or raises. `called`
runs it over a DataFrame: `together` requests at a time in each task, `tries` tries with
doubling pauses, then the fallback's reply. The number of partitions bounds how many run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def retried(model: Callable[[dict], object], fallback: Callable[[dict], object], tries: int = 5, pause: float = 1.0) -> Callable[[dict], object]:
    def call(request: dict) -> object:
        for k in range(tries):
            try:
                return model(request)
            except Exception:  # whatever the foreign model raises counts as a failed try
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
        return fallback(request)

    return call


def called(requests: DataFrame, model: Callable[[dict], object], reply: str, reply_type: str = "string", fallback: Callable[[dict], object] = lambda _: None, tries: int = 5, pause: float = 1.0, together: int = 10) -> DataFrame:
    """requests with a column `reply`."""
    schema = T.StructType([*requests.schema.fields, T.StructField(reply, T._parse_datatype_string(reply_type))])
    call = retried(model, fallback, tries, pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(together) as pool:
            for pdf in batches:
                yield pdf.assign(**{reply: list(pool.map(call, pdf.to_dict("records")))})

    return requests.mapInPandas(run, schema)


# --- offline doubles: the same for the same request ---


def stub_prompts(request: dict) -> str:
    return "\n".join(f"{k}. {request['type']} about {request['topics']}, {request['constraint']} ({k})" for k in range(1, 6))


def stub_completion(request: dict) -> str:
    return f"{request['prompt']} [{request['temperature']:.2f}]"


def stub_score(request: dict) -> str:
    n = sum(map(ord, request["text"])) if request["text"] else 0
    return f'{{"adherence": {n % 10 + 1}, "style": {n // 10 % 10 + 1}}}'


def stub_enhance(request: dict) -> str:
    return f"{request['prompt']} ({request['mix']})"


def stub_summary(before: str | None, messages: list) -> str:
    return f"{before + ' ' if before else ''}{len(messages)} messages."


def completions(prompts: DataFrame, temperatures: list[float], model: Callable[[dict], object] = stub_completion, **how) -> DataFrame:
    """prompt, type, constraint, completions (text, temperature, index): a small list of temperatures against every
    prompt; failed and empty completions go and leave gaps in index."""
    grid = prompts.select("*", F.posexplode(F.array(*(F.lit(float(t)) for t in temperatures))).alias("index", "temperature"))
    got = called(grid, model, "text", **how).where(F.length("text") > 0)
    keys = ["prompt", "type", "constraint"]
    made = got.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", "text", "temperature"))).alias("c"))
    return made.select(*keys, F.transform("c", lambda c: F.struct(c["text"].alias("text"), c["temperature"].alias("temperature"), c["index"].alias("index"))).alias("completions"))


def scored(completed: DataFrame, model: Callable[[dict], object] = stub_score, shown: int = 3000, tries: int = 3, **how) -> DataFrame:
    """A row a completion with adherence, style and total; a judge that fails gives 5 and 5."""
    from ..operators.preference import parsed_score

    flat = completed.select("prompt", "type", "constraint", F.explode("completions").alias("c")).select("prompt", "type", "constraint", F.col("c.index").alias("index"), F.col("c.text").alias("full"), F.left("c.text", F.lit(shown)).alias("text"))
    got = called(flat, model, "reply", fallback=lambda _: "", tries=tries, **how)
    return got.select("prompt", "type", "constraint", "index", F.col("full").alias("text"), parsed_score(F.coalesce("reply", F.lit(""))).alias("s")).select("prompt", "type", "constraint", "index", "text", "s.*")


def evaluated(prompts: DataFrame, model: Callable[[dict], object] = stub_completion, options: dict | None = None, together: int = 4) -> DataFrame:
    """prompts (prompt, type) with `text`, generated at fixed options; a call that fails gives its error in brackets."""
    asked = prompts.select("prompt", "type", *(F.lit(v).alias(k) for k, v in (options or {"temperature": 0.8, "top_p": 0.9, "repeat_penalty": 1.1, "max_tokens": 1024}).items()))

    def told(request: dict) -> object:
        try:
            return model(request)
        except Exception as e:  # the reason is the row's text
            return f"[ERROR: {e}]"

    return called(asked, told, "text", tries=1, together=together).select("prompt", "type", F.trim("text").alias("text"))


def healthy(probes: dict[str, Callable[[], bool]]) -> bool:
    """Whether every configured backend answers."""
    def up(probe: Callable[[], bool]) -> bool:
        try:
            return bool(probe())
        except Exception:  # a probe that raises is a backend that is down
            return False

    return bool(probes) and all(map(up, probes.values()))
