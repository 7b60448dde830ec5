"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir

__all__ = ["STRIDE", "WordHashes", "ascii_lower", "cut", "fold", "forget", "kept", "mixed", "scanned", "shared_dir", "table", "trim"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of one byte a character take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


STRIDE = 256


def scanned(xs: Column, zero: Column, step, out, stride: int = STRIDE) -> Column:
    """out(state, x) for every x of xs (a lambda's variable or a column), the state going from zero by step(state, x).

    Results are gathered by blocks of `stride`, so that time grows with the array's size and not its square.
    """
    blocks = F.sequence(F.lit(0), F.ceil(F.size(xs) / stride).cast("int") - 1)
    block = lambda b: F.slice(xs, b * stride + 1, F.lit(stride))
    nothing = F.transform(F.slice(xs, 1, 0), lambda x: out(zero, x))  # an empty array of the results' type
    states = F.aggregate(blocks, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.aggregate(block(b), F.element_at(acc, -1), step))))

    def filled(states: Column) -> Column:
        def one(b: Column) -> Column:
            begin = F.struct(F.get(states, b).alias("state"), nothing.alias("out"))
            return F.aggregate(block(b), begin, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(out(acc["state"], x))).alias("out")), lambda acc: acc["out"])

        return F.flatten(F.transform(blocks, one))

    return F.when(F.size(xs) > 0, F.transform(F.array(states), filled)[0]).otherwise(nothing)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered; emptied when it holds `most` of them."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_kept: dict = {}


def forget() -> None:
    """Let go of what an earlier operator's tasks kept in this worker process."""
    _kept.clear()
    trim()


def trim() -> None:
    """Give what this worker process has freed back to the machine; the allocators would hold it for the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def kept(key: tuple, build):
    """What a worker process keeps from task to task: one thing, the last asked for, so that models of earlier stages go."""
    if key not in _kept:
        forget()
        _kept[key] = build()
    return _kept[key]
