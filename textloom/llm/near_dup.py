"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidates.

1. A document's word shingles are hashed once; the hash range is cut into BINS, each bin
   keeps its least hash. An empty bin copies a filled one, the first by an order of its own
   (optimal densification). BANDS groups of bins give bucket keys.
2. Documents of equal sets are one node, known by a 64-bit hash of the set; only nodes go
   on, each with the smallest id that holds it. Two different sets would share a hash with
   probability (distinct sets)^2 / 2^65.
3. In each bucket every member is paired with the smallest: a star, so pairs are as many as
   members. Pairs are confirmed on full sets; connected components follow.
4. Buckets that still hold several components are open. What open buckets join, directly or
   over others, is a family; all its members of different components are compared on full
   sets, large families in pairs of blocks, each pair of blocks in a task. So no two
   documents that share a bucket are left untested unless they are in one component already.
5. Components are found by merging each node with its least neighbours and keeping the links
   between the merged, each step checkpointed.

Keys with more than HUB rows (the centre of a large star, a bucket or set that many share)
are dealt over several tasks in every join on them, the other side's row going to each.

A pair of similarity 0.8 shares none of the buckets with probability 5e-6; pairs that share
one are all compared, or in one component without that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import sweep
from .common import WordHashes, cut, forget, mixed, table, trim

BINS, ROWS = 240, 6
BANDS = BINS // ROWS
WORDS, SIMILAR = 5, 80  # the library's own setting; the op2 query takes four words
BLOCK, BLOCK_ITEMS = 2_000, 1_000_000  # about the most documents and shingles of a family's block
MOST_IDS = 1_000_000  # ids to broadcast to the scan; more go through a join
HUB, MOST_HUBS = 10_000, 50_000  # rows of a key that one task takes; keys to be dealt that may be sent to every task

_EDGES = np.array([(2**64 * k) // BINS for k in range(BINS)], dtype=np.uint64)
_ORDER = np.argsort(mixed(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=1).argsort(axis=1).astype(np.uint8)


def shingles(text: bytes, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, an empty one has none."""
    h = words.of(text.lower().split())
    n = len(h)
    if not n:
        return h
    width = min(n, size)
    s = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k])
    return np.unique(s)


def bands(s: np.ndarray) -> np.ndarray:
    at = np.searchsorted(s, _EDGES)
    full = np.append(at[1:], len(s)) > at
    sig = np.zeros(BINS, dtype=np.uint64)
    filled = np.flatnonzero(full)
    sig[filled] = s[at[filled]]
    if len(filled) < BINS:
        empty = np.flatnonzero(~full)
        sig[empty] = sig[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    sig = sig.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
    return key.view(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - 2**63


def lists(got: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum([len(g) for g in got])).astype(np.int32), np.concatenate(got) if got else np.zeros(0, np.int64))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n, node (hash of the set), bands (empty where only equal sets can link)."""
    least = -(-SIMILAR // (100 - SIMILAR))  # a smaller set links with its equals alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = WordHashes()
        for batch in batches:
            n, node, keys = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words, size)
                n.append(len(s))
                node.append(set_hash(s))
                keys.append(bands(s) if len(s) >= least else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists(keys)], names=["doc_id", "text_hash", "n", "node", "bands"])
        words.clear()
        trim()

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, node long, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, items: the full set of every node (node, rep: the id of a document that holds it), once each."""
    few = nodes.limit(MOST_IDS + 1).count() <= MOST_IDS
    reps = nodes.select(F.col("rep")).distinct()
    wanted = docs.join(F.broadcast(reps) if few else reps, docs["doc_id"] == reps["rep"], "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            got = [shingles(t, words, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_hash, got), pa.int64()), lists([g.view(np.int64) for g in got])], names=["node", "items"])
        words.clear()
        trim()

    return wanted.mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def hubs_of(rows: DataFrame, key: str, members: str | None = None) -> DataFrame | None:
    """key, parts: the keys with more than HUB rows, at most MOST_HUBS largest, and over how many tasks to deal them; None if there are none.

    members: the column of rows that holds their number, where it is known.
    """
    counts = rows.select(key, F.col(members).alias("c")) if members else rows.groupBy(key).agg(F.count("*").alias("c"))
    got = counts.where(F.col("c") > HUB).orderBy(F.desc("c"), key).limit(MOST_HUBS).collect()  # one job, unlike a limit without order
    return F.broadcast(rows.sparkSession.createDataFrame([(r[key], -(-r["c"] // HUB)) for r in got], f"{key} long, parts int")) if got else None


def met(left: DataFrame, right: DataFrame, on: str, hubs: DataFrame | None, by: Column) -> DataFrame:
    """left joined with right on a column of both; rows of hubs are dealt by a hash of `by`, right's go to each part."""
    if hubs is None:
        return left.join(right.hint("merge"), on)  # sides that grow with the corpus aren't gathered on the driver
    parts = F.coalesce("parts", F.lit(1))
    dealt = left.join(hubs, on, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    copied = right.join(hubs, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copied.hint("merge"), [on, "part"]).drop("part")


def confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, similar: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose full sets have the similarity: a, b."""
    hubs = hubs_of(pairs, "b")
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")).hint("merge"), "a")
    pairs = met(pairs, nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b", hubs, F.col("a"))
    possible = cut(pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similar).select("a", "b"))
    ends = possible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(sets_of(docs, cut(nodes.join(ends, "node", "left_semi").select("node", "rep")), size))
    left = possible.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = met(left, sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b", hubs, F.col("a"))
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u")).where(F.col("i") * 100 >= F.col("u") * similar).select("a", "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, for the nodes that links (a, b) name; a differs from b.

    Each round merges what is joined and goes on with the links between the merged, so links get fewer.
    Nodes are hashes: paths along which they fall, which take a round for every two steps, are short.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n, labels = edges.count(), None
    while n or labels is None:
        hubs = {x: hubs_of(edges, x) if n > HUB else None for x in "ab"}
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("at"))
        # nothing follows this join and that of the labels but their writing, so Spark itself splits the rows of a node that many point to
        to = cut(near.join(near.select(F.col("node").alias("at"), F.col("at").alias("label")).hint("merge"), "at").select("node", "label"))
        ends = {x: to.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab"}
        met_b = met(edges, ends["b"], "b", hubs["b"], F.col("a")).select("a", "lb")
        merged = met(met_b, ends["a"], "a", hubs["a"], F.col("lb")).where("la <> lb")
        edges = cut(merged.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        over = to.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = to if labels is None else cut(labels.join(over.hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        n = edges.count()
        sweep(edges.sparkSession)
    return labels


def near_duplicates(docs: DataFrame, size: int = WORDS, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs.

    Two texts link if 100 * intersection >= similar * union of their sets (similar at
    least SIMILAR, for which the bands are laid out). Null and empty texts have no
    shingles and link with nothing. Equal texts link at once. Rows repeated with one id
    and text get a row each; an id's other texts are documents of their own. Rows without
    id link with nothing: their component is null and they are kept. An empty table gives
    no rows. Other columns are not read. text_hash: xxhash64, of a null text that of "".
    """
    if similar < SIMILAR:
        raise ValueError(f"the bands find pairs of similarity {SIMILAR} or more")
    docs = _source(docs, id_col, text_col)
    sweep(docs.sparkSession)
    sketch = cut(sketched(docs, size))
    linking = sketch.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = cut(linking.groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    one = linking.where(F.size("bands") > 0).join(nodes.select("node", "rep").hint("merge"), (linking["node"] == nodes["node"]) & (F.col("doc_id") == F.col("rep")), "left_semi")
    rows = cut(one.select("node", "bands").distinct()).select("node", F.explode("bands").alias("key"))
    stars = cut(rows.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("members")).where(F.col("members") > 1))
    crowded = hubs_of(stars, "key", "members")
    held = cut(met(rows, stars.select("key", "b"), "key", crowded, F.col("node")))
    pairs = cut(held.where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct())
    links = confirmed(docs, pairs, nodes, size, similar)
    labels = components(links)
    sweep(docs.sparkSession)
    more = _again(docs, held, labels, nodes, crowded, size, similar)
    if more is not None and more.count():  # they join labels
        of = labels.select("node", F.col("label").alias("at"))
        ends = [of.withColumnRenamed("node", x).withColumnRenamed("at", f"l{x}") for x in "ab"]
        pairs = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        joined = components(pairs.where("a <> b"))
        over = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = labels.join(over, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(joined.join(labels, "node", "left_anti").select("node", "label"))
    placed = cut(nodes.join(labels.hint("merge"), "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")))
    least = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = met(placed.select("node", "label"), least, "label", hubs_of(placed, "label"), F.col("node")).select("node", "component_id")
    told = met(linking.select("doc_id", "text_hash", "n", "node"), found, "node", hubs_of(nodes, "node", "copies"), F.monotonically_increasing_id())
    alone = sketch.where((F.col("n") == 0) | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")]
    return told.select(*columns).unionByName(alone.select(*columns))


def joining(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, similar: int) -> list[tuple[int, int]]:
    """Links between left and right (positions in sets) that join different labels, none of which others given here imply."""
    labels, out = labels.copy(), []
    sizes = np.array([len(sets[r]) for r in right])
    items = np.concatenate([sets[r] for r in right])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], np.repeat(np.arange(len(right)), sizes)[order]
    for a in left:
        if (labels[right] == labels[a]).all():
            continue
        at, to = np.searchsorted(items, sets[a], "left"), np.searchsorted(items, sets[a], "right")
        n = to - at
        common = np.bincount(owner[np.arange(n.sum()) + np.repeat(at - np.cumsum(n) + n, n)], minlength=len(right))
        met = right[(common > 0) & (common * 100 >= (len(sets[a]) + sizes - common) * similar)]
        while len(met := met[labels[met] != labels[a]]):
            out.append((a, met[0]))
            labels[labels == labels[met[0]]] = labels[a]
    return out


def _again(docs: DataFrame, held: DataFrame, labels: DataFrame, nodes: DataFrame, crowded: DataFrame | None, size: int, similar: int) -> DataFrame | None:
    """Links between members of families of buckets that the stars left in several components; None if there are no such buckets."""
    placed = cut(held.join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("first")).where("lo <> hi").select("key", "first")
    members = cut(met(placed, open_keys, "key", crowded, F.col("node")).select("node", "label", "first").distinct())
    if not members.count():
        return None
    family = components(members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))).select("node", F.col("label").alias("family"))
    inside = cut(members.select("node", "label").distinct().join(family, "node").join(nodes.drop("copies"), "node").select("node", "rep", "n", "label", "family"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")
    sized = inside.groupBy("family").agg(blocks.alias("blocks"))
    dealt = met(inside.select("node", "label", "family"), sized, "family", hubs_of(inside, "family"), F.col("node")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = cut(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    sets = sets_of(docs, inside.select("node", "rep"), size)
    tasks = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label").join(sets, "node")

    def run(key: tuple, got: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        got = got.combine_chunks()
        items = got["items"].combine_chunks()
        flat, ends = items.flatten().to_numpy(), np.append(0, np.cumsum(items.value_lengths().to_numpy()))
        sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        nodes, labels, block = (got[c].to_numpy() for c in ("node", "label", "block"))
        links = joining(sets, labels, np.flatnonzero(block == i), np.flatnonzero(block == j), similar) if (block == i).any() and (block == j).any() else []
        return pa.table({"a": pa.array([nodes[x] for x, _ in links], pa.int64()), "b": pa.array([nodes[y] for _, y in links], pa.int64())})

    return cut(tasks.groupBy("family", "i", "j").applyInArrow(run, "a long, b long"))


def op2_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("text_hash")


_SETS = """
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 4) - 1], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c))
"""
SQL = {
    "op2_one_permutation": f"""
WITH RECURSIVE {_SETS.strip()},
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS c FROM r GROUP BY node) m ON m.node = d.doc_id
"""
}
QUERIES = {"op2_one_permutation": op2_one_permutation}
