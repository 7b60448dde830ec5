"""Exact top-k inner products over norm-sorted vectors.

Vectors become integers, floor(scale * x). A basis from the singular vectors of the
second-moment matrix (dimensions squared, summed over all rows) turns them so that the
first HEAD coordinates carry most of the length.

1. The FIRST longest vectors, a bounded set, give every query a start: its k-th best score
   among them, and so the least length that a vector must have to matter to it.
2. Vectors are dealt into blocks by falling length, queries into blocks by rising least
   length; small neighbouring partitions make one block. A block of queries meets only those blocks of vectors that hold a vector long
   enough: one group of a co-grouping each, so the plan doesn't grow with either table.
3. In a group vectors come in slabs by falling length: the sum over the head coordinates
   plus the product of the residual lengths bounds the inner product (Cauchy-Schwarz),
   pairs whose bound is below the query's k-th best are dropped, the others get their exact
   integer score; it ends when no query can be helped by the lengths that are left.
4. The groups' lists are merged by score, ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K, SCALE, HEAD, BLOCK, SLAB = 10, 1024, 16, 4096, 512
HOLD, LEAST = 65_536, 2048  # vectors of a block: the most, and the least that blocks are cut to for the sake of idle cores
FIRST = 4096  # longest vectors that give the queries their start
MOST = 2**63  # least number that a sum of products must stay below
SLACK = 1e-9  # relative error allowed to lengths and turned coordinates


def as_integers(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and v (array<long>) of the rows whose vector is there and finite throughout."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).withColumnRenamed("e", vec_col).where(fine & (F.size(vec_col) > 0))
    return rows.select("vec_id", F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    for i, x in enumerate(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []):
        out[i, : len(x)] = x
    return out


def small(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether floats hold every sum of products exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows."""
    kind = np.float64 if small(q, x) else np.int64
    return np.einsum("ij,ij->i", q.astype(kind), x.astype(kind)).astype(np.int64)


def all_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows with all rows."""
    if small(q, x):
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Asked:
    """Queries with the best that each has met so far; start: scores below which nothing matters."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, start: np.ndarray, turn: np.ndarray, k: int, head: int):
        self.ids, self.q, self.k, self.head, self.turn = ids, q, k, head, turn
        turned = q.astype(np.float64) @ turn
        self.head_part, self.rest = turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(1))
        self.length = np.sqrt((turned**2).sum(1))
        self.top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.floor = start.astype(np.float64)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        turned = x.astype(np.float64) @ self.turn
        length = np.sqrt((turned**2).sum(1))
        order = np.argsort(-length, kind="stable")
        ids, x, turned, length = ids[order], x[order], turned[order], length[order]
        for a in range(0, len(ids), SLAB):
            z = slice(a, a + SLAB)
            if not self._slab(ids[z], x[z], turned[z], length[z]):
                return

    def _slab(self, ids: np.ndarray, x: np.ndarray, turned: np.ndarray, length: np.ndarray) -> bool:
        """False: no query can be helped by vectors of these lengths or shorter ones."""
        live = np.flatnonzero(self.length * length[0] * (1 + SLACK) + 1 >= self.floor)
        if not len(live):
            return False
        rest = np.sqrt((turned[:, self.head :] ** 2).sum(1))
        bound = self.head_part[live] @ turned[:, : self.head].T + self.rest[live, None] * rest
        floor = self.floor[live, None]
        a, b = np.nonzero(bound + 1 + SLACK * self.length[live, None] * length >= floor)
        if len(a) * 8 > bound.size:  # so many that a product of matrices is less work than picking them
            every = all_products(self.q[live], x)
            a, b = np.nonzero(every >= floor)
            s = every[a, b]
        else:
            s = np.concatenate([exact_products(self.q[live[a[i : i + 200_000]]], x[b[i : i + 200_000]]) for i in range(0, len(a), 200_000)]) if len(a) else np.zeros(0, np.int64)
        keep = (s >= self.floor[live[a]]) & (self.ids[live[a]] != ids[b])
        a, b, s = a[keep], b[keep], s[keep]
        at = np.searchsorted(a, np.arange(len(live) + 1))
        for i in np.flatnonzero(at[1:] > at[:-1]):
            z, one = slice(at[i], at[i + 1]), live[i]
            scores, found = np.concatenate([self.top[one][0], s[z]]), np.concatenate([self.top[one][1], ids[b[z]]])
            some = best(scores, found, self.k)
            self.top[one] = (scores[some], found[some])
            if len(some) == self.k:
                self.floor[one] = max(self.floor[one], scores[some[-1]])
        return True


def basis(base: DataFrame, width: int) -> np.ndarray:
    """Singular vectors of the sum of all vectors' outer products."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(np.float64)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "x"])

    cells = base.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # width * width
    second = np.zeros((width, width))
    for c in cells:
        second[c["i"], c["j"]] = c["x"]
    return np.linalg.svd(second)[0]


def blocks_of(parts: dict[int, int], most: int) -> dict[int, int]:
    """The block of each part (its number and rows): neighbours share one as long as they have at most `most` rows together.

    So however many parts Spark deals rows into, a block's rows and not the number of parts say how often the other side is sent.
    """
    out, block, held = {}, 0, 0
    for part in sorted(parts):
        if held and held + parts[part] > most:
            block, held = block + 1, 0
        out[part], held = block, held + parts[part]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, head: int = HEAD, block: int = BLOCK, hold: int = HOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with the other vectors.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor
    do rows without id. A query leaves out every row of its own id. Shorter vectors count
    as ending in zeros. Rows repeated in `vectors` are candidates each; repeated queries are
    asked once, and different vectors of one id are queries of their own. Empty tables give no rows. Components so large that
    a score might not fit a long raise OverflowError. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    base = cut(as_integers(vectors, id_col, vec_col, scale))
    asked = cut(as_integers(queries, id_col, vec_col, scale).distinct())
    extent = lambda df: df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))).alias("m")).first()
    n, w, m = extent(base)
    n_asked, w_asked, m_asked = extent(asked)
    if not n or not n_asked:
        return spark.createDataFrame([], schema)
    width = max(w, w_asked)
    if max(m * m, m * m_asked) * width >= MOST:
        raise OverflowError("inner products of these components may not fit a long")
    turn, head = basis(base, width), min(head, width)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    base, asked = base.withColumn("len", length), asked.withColumn("len", length)
    longest = base.orderBy(F.desc("len"), "vec_id").limit(FIRST).select("vec_id", "v").toArrow()  # FIRST rows
    first = spark.sparkContext.broadcast((longest["vec_id"].to_numpy(), matrix(longest["v"], width)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = first.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                q = Asked(part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1), width), np.full(part.num_rows, -np.inf), turn, k, head)
                q.meet(ids, x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(q.floor), pa.array(np.maximum(q.floor, 0.0) / np.maximum(q.length, 1.0) * (1 - SLACK))], names=["vec_id", "v", "len", "start", "need"])

    started = asked.mapInArrow(begin, "vec_id long, v array<long>, len double, start double, need double")
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-n // hold), min(cores, -(-n // LEAST)))
    dealt = cut(base.repartitionByRange(blocks, F.desc("len"), "vec_id").withColumn("part", F.spark_partition_id()))
    q_blocks = -(-n_asked // block)
    q_dealt = cut(started.repartitionByRange(q_blocks, "need", "vec_id").withColumn("q_part", F.spark_partition_id()))
    # a number a part; blocks of vectors stand by falling length, those of queries by rising need: each meets the first few of the others
    lengths = dealt.groupBy("part").agg(F.count("*").alias("n"), F.max("len").alias("x")).collect()
    needs = q_dealt.groupBy("q_part").agg(F.count("*").alias("n"), F.min(F.when(F.col("len") > 0, F.col("need")).otherwise(0.0)).alias("x")).collect()
    of_part, of_q_part = blocks_of({r["part"]: r["n"] for r in lengths}, -(-n // blocks)), blocks_of({r["q_part"]: r["n"] for r in needs}, -(-n_asked // q_blocks))
    length_of, need_of = [0.0] * (max(of_part.values()) + 1), [np.inf] * (max(of_q_part.values()) + 1)
    for r in lengths:
        length_of[of_part[r["part"]]] = max(length_of[of_part[r["part"]]], r["x"])
    for r in needs:
        need_of[of_q_part[r["q_part"]]] = min(need_of[of_q_part[r["q_part"]]], r["x"])
    by_length, by_need = np.sort([-x * (1 + SLACK) for x in length_of]), np.sort(need_of)
    before = lambda edges, x: int(np.searchsorted(edges, x, side="right"))
    v_reach = [(p, k, met - 1) for p, k in of_part.items() if (met := before(by_need, length_of[k] * (1 + SLACK)))]
    q_reach = [(p, k, met - 1) for p, k in of_q_part.items() if (met := before(by_length, -need_of[k]))]
    known = lambda rows, part, own: F.broadcast(spark.createDataFrame(rows, f"{part} int, {own} int, last int"))
    left = q_dealt.join(known(q_reach, "q_part", "q_block"), "q_part").select("q_block", F.explode(F.sequence(F.lit(0), "last")).alias("block"), "vec_id", F.xxhash64("v").alias("query"), "v", "start")
    right = dealt.join(known(v_reach, "part", "block"), "part").select(F.explode(F.sequence(F.lit(0), "last")).alias("q_block"), "block", "vec_id", "v")

    def search(key: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "query", "vec_id", "score")})
        asking = Asked(q["vec_id"].to_numpy(), matrix(q["v"], width), q["start"].to_numpy(), turn, k, head)
        asking.meet(x["vec_id"].to_numpy(), matrix(x["v"], width))
        counts = [len(t[0]) for t in asking.top]
        columns = [np.repeat(asking.ids, counts), np.repeat(q["query"].to_numpy(), counts), np.concatenate([t[1] for t in asking.top]), np.concatenate([t[0] for t in asking.top])]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query", "vec_id", "score"])

    found = left.groupBy("q_block", "block").cogroup(right.groupBy("q_block", "block")).applyInArrow(search, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_norm_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op9_norm_sorted_search": op9_norm_sorted_search}
SQL = {
    "op9_norm_sorted_search": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
