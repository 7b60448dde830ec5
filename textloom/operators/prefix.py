"""The shingles by which texts are joined with similar ones: those that rank first, the rare before the common.

Texts go by chunks. A chunk's shingles are sorted and sent by ranges of the first 48 bits of
their hashes, six bytes each with the place of their text in the chunk. Each range of all
chunks is counted in one task, and the shingles of more than one text go back to their
chunk, each with its class of counts. Shingles that share the 48 bits count as one: that
makes candidates and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shingles import Words, shingle_set

CHUNK, CHUNK_DOCS = 1_000_000, 2**16  # about the most shingles, and the most texts, of a chunk
RANGE_OCTETS = 8_000_000  # of text for each range, that is about a million shingles
ROWS = 256  # texts that are Python's at one time
_32 = np.uint64(32)


def id_type(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """ids and texts, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS).to_pylist()


def sets(lowered: DataFrame, size: int) -> DataFrame:
    """id, s: the hashes of the shingles of lower-case texts (id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for ids, texts in texts_of(batches):
            got = [shingle_set(t, words, size).view(np.int64) for t in texts]
            ends = np.append(0, np.cumsum([len(g) for g in got])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, np.concatenate(got))], names=["id", "s"])

    return lowered.mapInArrow(run, f"id {id_type(lowered)}, s array<long>")


def edges_of(parts: int) -> np.ndarray:
    """Where the ranges begin, by the first 16 bits, and the end."""
    return (np.arange(parts + 1, dtype=np.uint64) * np.uint64(2**16) + np.uint64(parts - 1)) // np.uint64(parts)


def packed(k: np.ndarray, begin: int, end: int) -> tuple[bytes, bytes]:
    """Sorted 48-bit numbers whose first 16 bits are from begin to end - 1: the last 32 bits of each, and how many have each beginning."""
    return k.astype(np.uint32).tobytes(), np.bincount((k >> _32).astype(np.int64) - int(begin), minlength=int(end - begin)).astype(np.uint32).tobytes()


def unpacked(low: bytes, high: bytes, begin: int) -> np.ndarray:
    counts = np.frombuffer(high, np.uint32)
    return (np.repeat(np.arange(begin, begin + len(counts), dtype=np.uint64), counts) << _32) | np.frombuffer(low, np.uint32)


def prefixes(lowered: DataFrame, threshold: float, size: int) -> DataFrame:
    """id, n (size of its set), rest (how many shingles come from k on), k of lower-case texts (id, t), neither null."""
    kind = id_type(lowered)
    octets = lowered.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = int(min(2**16, octets // RANGE_OCTETS + 1))
    edges = edges_of(parts)
    blobs = "low binary, high binary, doc binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, name = Words(), TaskContext.get().partitionId() << 32

        def chunk(ids: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
            n = np.array([len(s) for s in sets], np.int32)
            k = np.concatenate(sets) >> np.uint64(16)
            order = np.argsort(k, kind="stable")
            k, doc = k[order], np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
            at = np.searchsorted(k, edges << _32)
            held = [(int(p), *packed(k[at[p] : at[p + 1]], edges[p], edges[p + 1]), doc[at[p] : at[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(at))]
            part, *rest = zip(*held, (name % parts, None, None, None), strict=True)  # the last row is the chunk's own
            one = np.append(np.zeros(len(part)), len(n)).astype(np.int32)
            columns = [pa.array(part, pa.int32()), pa.array([name] * len(part), pa.int64()), *(pa.array(x, pa.binary()) for x in rest)]
            columns += [pa.ListArray.from_arrays(one, pa.concat_arrays(ids)), pa.ListArray.from_arrays(one, pa.array(n))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "low", "high", "doc", "ids", "n"])

        ids, sets, held = [], [], 0
        for some, texts in texts_of(batches):
            got = [shingle_set(t, words, size) for t in texts]
            keep = [x for x, s in enumerate(got) if len(s)]
            ids.append(some.take(pa.array(keep, pa.int32())))
            sets += [got[x] for x in keep]
            held += sum(map(len, got))
            if held >= CHUNK or len(sets) > CHUNK_DOCS - ROWS:
                yield chunk(ids, sets)
                ids, sets, held, name = [], [], 0, name + 1
        if sets:
            yield chunk(ids, sets)

    def count(key: tuple, got: pa.Table) -> pa.Table:
        p = key[0].as_py()
        rows = [r for r in got.select(["chunk", "low", "high", "doc"]).to_pylist() if r["low"] is not None]
        ks = [unpacked(r["low"], r["high"], int(edges[p])) for r in rows]
        own = got.filter(got["low"].is_null())
        out = [pa.table({"part": own["part"], "chunk": own["chunk"], "low": own["low"], "high": own["high"], "doc": own["doc"], "q": own["low"], "ids": own["ids"], "n": own["n"]})]
        if ks:
            k = np.concatenate(ks)
            order = np.argsort(k, kind="stable")
            n = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(k[order]) > 0)), len(k)))
            q = np.empty(len(k), np.uint8)
            q[order] = np.repeat(np.minimum(255, 8 * np.log2(n)).astype(np.uint8), n)  # 0: of one text alone
            back, at = [], 0
            for r, k in zip(rows, ks, strict=True):
                of = q[at : at + len(k)]
                at += len(k)
                low, high = packed(k[of > 0], edges[p], edges[p + 1])
                back.append({"part": p, "chunk": r["chunk"], "low": low, "high": high, "doc": np.frombuffer(r["doc"], np.uint16)[of > 0].tobytes(), "q": of[of > 0].tobytes()})
            out.append(pa.Table.from_pylist([r | {"ids": None, "n": None} for r in back], schema=out[0].schema))
        return pa.concat_tables(out)

    def rank(key: tuple, got: pa.Table) -> pa.Table:
        own = got.filter(got["low"].is_null())
        ids, n = (own[x].combine_chunks().flatten() for x in ("ids", "n"))
        n = n.to_numpy()
        rows = [r for r in got.select(["part", "low", "high", "doc", "q"]).to_pylist() if r["low"]]
        none = [np.zeros(0, np.uint64)]
        k = np.concatenate([*none, *(unpacked(r["low"], r["high"], int(edges[r["part"]])) for r in rows)])
        doc, q = (np.frombuffer(b"".join(r[x] for r in rows), kind) for x, kind in (("doc", np.uint16), ("q", np.uint8)))
        alone = n - np.bincount(doc, minlength=len(n))
        left = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1 - alone
        some = left[doc] > 0
        k, doc, q = k[some], doc[some], q[some]
        order = np.lexsort((k, q, doc))
        k, doc = k[order], doc[order].astype(np.int64)
        place = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(n)))[doc]
        first = place < left[doc]
        doc, place = doc[first], place[first]
        return pa.table({"id": ids.take(pa.array(doc)), "n": pa.array(n[doc]), "rest": pa.array((n[doc] - alone[doc] - place).astype(np.int32)), "k": pa.array(k[first].view(np.int64))})

    sent = lowered.mapInArrow(send, f"part int, chunk long, {blobs}, ids array<{kind}>, n array<int>")
    counted = sent.groupBy("part").applyInArrow(count, f"part int, chunk long, {blobs}, q binary, ids array<{kind}>, n array<int>")
    return counted.groupBy("chunk").applyInArrow(rank, f"id {kind}, n int, rest int, k long")
