"""Near-duplicate detection by an LSH forest over MinHash signatures.

1. Each text becomes a set of hashed 5-word shingles, a digest of that set and ``VALUES`` MinHash
   values of 16 bits.  Equal sets are one node from here on, so groups of copies cost one row each.
2. Forest: each of ``TREES`` trees orders all nodes by its own slice of the signature, sorted
   globally by range partitions (the id breaks ties, so no run of equal keys lands in one task).
   In sorted order a node's neighbours with a common prefix of ``MIN_DEPTH`` or more values are
   candidates.  Depth adapts to each region: a run with a common prefix that has at most ``REGION``
   nodes gives all its pairs; a denser one is cut at the next value.  Runs across the end of a
   partition are joined from its edge rows.
3. Candidates whose signatures agree far too little are dropped (``SLACK`` standard errors below the
   threshold), and so are those whose set sizes rule the threshold out.
4. The rest is confirmed on full sets: first each node's likeliest partner, then every remaining
   candidate between different components.  Components come from the confirmed links.
5. Nodes of runs that were cut (over ``REGION`` nodes share ``MIN_DEPTH`` values) and hold more than
   one component are joined once more on their full sets: in one order of all shingles, common ones
   last, two sets that reach the threshold share a shingle among their first quarter, and its places
   bound what they can share.  This join loses no pair, whatever the order.

Chance of missing a link at similarity 0.75: each tree finds it with 0.75 ** 2, all 16 miss it with
2e-6, and so in dense regions, where the join covers what the cuts leave out.

Defined results: null or blank texts have an empty set and are linked with nothing; texts under five
words are one shingle; rows that repeat an id are one document with several texts, so what any of them is
linked with is in one component (rows without words stay apart); rows without an id are returned
unlinked; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, small_batches, table, written
from .components import components

SHINGLE = 5
PERCENT = 75
VALUES = 64
TREES = 16
DEPTH = 12
MIN_DEPTH = 2
REGION = 24
#: Standard errors below the threshold at which a signature rules a pair out.
SLACK = 5.0
#: Nodes of cut runs whose shingles are counted to tell common ones, and common ones told; both touch time only.
COUNTED_NODES = 10_000
MAX_COMMON = 200_000
#: Rows of a sorted partition.
SORTED_ROWS = 400_000
#: Ids to fetch are broadcast up to this number (16 MB of longs), beyond it joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(2024)
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words, remembered; it is emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(SHINGLE, len(w))
    s = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        s = (s ^ h[i : len(w) - n + 1 + i]) * _MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> bytes:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, (s[i : i + 2048, None] * _A + _B).min(0), out=least)
    return ((least * _MIX) >> np.uint64(48)).astype(">u2").tobytes()


def sketches(docs: DataFrame, keep_set: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest and signature (or the packed set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, 500):
            n, digest, last = [], [], []
            for x in batch.column(1):
                s = shingle_set(x.as_py(), words)
                raw = s.tobytes()
                n.append(len(s))
                digest.append(hashlib.blake2b(raw, digest_size=16).digest() if len(s) else None)
                last.append(raw if keep_set else signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(last, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, digest binary, sketch binary")


def forest_pairs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of candidates among rows sorted by ``keys`` (n, 1 + DEPTH: tree, then values)."""
    n = len(keys)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = keys[1:] == keys[:-1]
    depth = np.where(same.all(1), DEPTH + 1, same.argmin(1)) - 1  # values in common with the row before; -1: another tree
    one = np.flatnonzero(depth >= MIN_DEPTH)
    two = np.flatnonzero(np.minimum(depth[:-1], depth[1:]) >= MIN_DEPTH)
    left, right = [one, two], [one + 1, two + 2]
    todo = np.ones(n, bool)
    for d in range(MIN_DEPTH, DEPTH + 1):
        cut = np.flatnonzero(depth < d) + 1
        start, end = np.r_[0, cut], np.r_[cut, n]
        size = end - start
        for k in np.flatnonzero((size > 3) & (size <= REGION) & todo[start]):
            i, j = np.triu_indices(size[k], 3)
            left.append(i + start[k])
            right.append(j + start[k])
        for k in np.flatnonzero((size <= REGION) & (size > 1)):
            todo[start[k] : end[k]] = False
        if not todo.any():
            break
    return np.concatenate(left), np.concatenate(right)


def _key_rows(frame: pd.DataFrame) -> np.ndarray:
    keys = np.frombuffer(b"".join(frame["key"]), ">u2").reshape(-1, DEPTH)
    return np.hstack([frame["tree"].to_numpy(np.int32)[:, None], keys.astype(np.int32)])


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Set sizes that allow the threshold."""
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def dense_rows(keys: np.ndarray) -> np.ndarray:
    """Indices of rows whose run has over ``REGION`` rows here or may go on beyond this partition."""
    new = np.r_[True, (keys[1:, : MIN_DEPTH + 1] != keys[:-1, : MIN_DEPTH + 1]).any(1)]
    run = np.cumsum(new) - 1
    some = np.bincount(run) > REGION
    some[[0, -1]] = True
    return np.flatnonzero(some[run])


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (node, n, sig) to distinct candidate pairs (a, b), a < b, and the nodes of large runs (node, tree, prefix)."""
    rows = nodes.count() * TREES
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED_ROWS))
    twice = F.concat("sig", "sig")
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring(twice, t * (2 * VALUES // TREES) + 1, F.lit(2 * DEPTH)).alias("key"))))
    order = ["tree", "key", "node"]
    ordered = nodes.select("node", "n", trees.alias("t")).select("t.tree", "t.key", "node", "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["tree", "key", "node", "n"])], ignore_index=True)
        if not len(frame):
            return
        ids, n = frame["node"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        keys = _key_rows(frame)
        i, j = forest_pairs(keys, ids)
        ok = (ids[i] != ids[j]) & _fits(n[i], n[j])
        i, j = i[ok], j[ok]
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        yield pd.DataFrame({"a": a, "b": b, "part": -1, "tree": 0, "key": b"", "n": 0, "tail": False}).drop_duplicates(["a", "b"])
        dense = frame.iloc[dense_rows(keys)]
        yield pd.DataFrame({"a": dense["node"], "b": dense["node"], "part": -2, "tree": dense["tree"], "key": dense["key"].str.slice(0, 2 * MIN_DEPTH), "n": 0, "tail": False})
        part = TaskContext.get().partitionId()
        for tail, edge in ((False, frame.head(REGION)), (True, frame.tail(REGION))):
            yield pd.DataFrame({"a": edge["node"], "b": edge["node"], "part": part, "tree": edge["tree"], "key": edge["key"], "n": edge["n"], "tail": tail})

    kind = "a long, b long, part int, tree int, key binary, n long, tail boolean"
    found = written(ordered.mapInPandas(run, kind))
    # the last rows of a partition and the first of the next, numbered by the seam between them
    edges = found.filter("part >= 0")
    place = edges.select("part").distinct().select("part", F.row_number().over(W.orderBy("part")).alias("at"))  # a row per partition
    seams = edges.join(F.broadcast(place), "part").withColumn("seam", F.col("at") + F.col("tail").cast("int"))

    def cross(frame: pd.DataFrame) -> pd.DataFrame:
        keys, ids, n, tail = _key_rows(frame), frame["a"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), frame["tail"].to_numpy(bool)
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(tail), np.flatnonzero(~tail), indexing="ij"))
        ok = (keys[i, : MIN_DEPTH + 1] == keys[j, : MIN_DEPTH + 1]).all(1) & (ids[i] != ids[j]) & _fits(n[i], n[j])
        i, j = i[ok], j[ok]
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    across = seams.groupBy("seam").applyInPandas(cross, "a long, b long")
    runs = found.filter("part = -2").select(F.col("a").alias("node"), "tree", F.col("key").alias("prefix"))
    return found.filter("part = -1").select("a", "b").unionByName(across).distinct(), runs


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` with ``alike``, the share of equal signature values, without those ruled out."""

    # said to be nondeterministic, so that it isn't evaluated once to filter and once more to select
    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        a, b = (np.frombuffer(b"".join(s), ">u2").reshape(-1, VALUES) for s in (x, y))
        return pd.Series((a == b).mean(1))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", alike.asNondeterministic()("sig_a", "sig_b").alias("alike")).filter(F.col("alike") >= least_alike())


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets (node, set) reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            a, b, good = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= PERCENT * (len(both) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All confirmed links (a, b), beside the given ones, and their components; ``pairs`` are between components so far."""
    # each node's likeliest partner first; it settles most groups with one check per node
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "alike").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "alike"))
    best = ends.groupBy("x").agg(F.max_by("y", F.struct("alike", -F.col("y"))).alias("y"))
    first = confirm(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), sets)
    links = written(first if links is None else first.unionByName(links))
    groups = written(components(links))
    side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"group_{c}"))
    rest = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("group_a IS NULL OR group_b IS NULL OR group_a <> group_b").select("a", "b")
    more = written(confirm(rest, sets))
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = written(components(links))
    return links, groups


def dense_nodes(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """``runs`` (node, tree, prefix) to the distinct nodes (node, group) of those over ``REGION`` nodes and one component."""
    named = runs.join(groups, "node", "left").select("node", "tree", "prefix", F.coalesce("component", "node").alias("group"))
    large = named.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.min("group").alias("least"), F.max("group").alias("most"))
    large = written(large.filter((F.col("size") > REGION) & (F.col("least") < F.col("most"))).select("tree", "prefix"))
    return named.join(F.broadcast(large) if large.count() <= MAX_BROADCAST_IDS else large, ["tree", "prefix"], "left_semi").select("node", "group").distinct()


def common_shingles(sets: DataFrame, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat among a hash sample of the sets, sorted, and how often they do."""
    share = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < -(-1_000_000 * COUNTED_NODES // max(nodes, COUNTED_NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)]))], ["shingle"])

    counts = sets.filter(share).select("set").mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 1")
    top = counts.orderBy(F.desc("count"), "shingle").limit(MAX_COMMON).toPandas()
    shingle, count = top["shingle"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], count[order]


def first_shingles(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set that come first, common ones last: sets that reach the threshold share one of them."""
    often = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        often = np.where(common[at] == s, counts[at], 0)
    return s[np.argsort(often, kind="stable")][: len(s) - -(-PERCENT * len(s) // 100) + 1]


def least_alike() -> float:
    """The share of equal signature values below which a pair is ruled out."""
    p = PERCENT / 100
    return p - SLACK * (p * (1 - p) / VALUES) ** 0.5


def joined_pairs(sets: DataFrame, nodes: int) -> DataFrame:
    """``sets`` (node, group, set) to all pairs (a, b) of different groups that may reach the threshold."""
    common, counts = common_shingles(sets, nodes)
    told = sets.sparkSession.sparkContext.broadcast((common, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = told.value
        for batch in slices(batches, 200):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            first = [first_shingles(s, common, counts) for s in sets]
            k, n = np.array([len(f) for f in first]), np.array([len(s) for s in sets])
            # what two sets can share whose first common shingle is this one
            most = np.repeat(n, k) - np.concatenate([np.arange(len(f)) for f in first])
            each = [np.concatenate(first).view(np.int64), *(np.repeat(x, k) for x in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), n)), most]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in each], names)

    names = ["shingle", "node", "group", "n", "most"]
    rows = written(sets.select("node", "group", "set").mapInArrow(run, ", ".join(f"{c} long" for c in names)))
    enough = lambda c: f"{100 + PERCENT} * most_{c} >= {PERCENT} * (n_a + n_b)"
    side = lambda c: rows.select("shingle", *(F.col(x).alias(f"{x}_{c}") for x in names[1:]))
    # the smaller set's place is within what an equal set allows
    small = side("a").filter(f"{100 + PERCENT} * most_a >= {2 * PERCENT} * n_a").hint("merge")
    pairs = small.join(side("b"), "shingle").filter(f"(n_a < n_b OR n_a = n_b AND node_a < node_b) AND group_a <> group_b AND {enough('a')} AND {enough('b')}")
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The packed sets (node, set) of the nodes ``ids`` (node), each from its least document."""
    wanted = written(nodes.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "node", "left_semi").select("node", "doc_id", "digest"))
    some = wanted.select(F.col("doc_id").alias("wanted_id"))
    rows = docs.join(F.broadcast(some) if some.count() <= MAX_BROADCAST_IDS else some, docs["doc_id"] == some["wanted_id"], "left_semi")
    sets = sketches(rows, keep_set=True).select("doc_id", "digest", F.col("sketch").alias("set"))
    return written(sets.join(wanted, ["doc_id", "digest"]).select("node", "set").dropDuplicates(["node"]))


def same_id(usable: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that share an id: rows that repeat it with other texts."""
    repeated = usable.select("doc_id", "digest").distinct().withColumn("n", F.count("*").over(W.partitionBy("doc_id"))).filter("n > 1")
    named = repeated.join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    return named.withColumn("a", F.min("node").over(W.partitionBy("doc_id"))).filter("a < node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = written(sketches(docs))
    usable = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x"))
    # numbered when written, and read from there ever after
    nodes = written(nodes.select("digest", F.monotonically_increasing_id().alias("node"), F.col("x.doc_id").alias("doc_id"), F.col("x.n_shingles").alias("n"), F.col("x.sketch").alias("sig")))
    one = nodes.select("node", "n", "sig")
    found, runs = candidates(one)
    pairs = written(likely(found, one))
    ids = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    links, groups = linked(pairs, full_sets(docs, nodes, ids))
    dense = written(dense_nodes(runs, groups))
    size = dense.count()
    if size:
        sets = full_sets(docs, nodes, dense.select("node"))
        missed = written(likely(joined_pairs(sets.join(dense, "node"), size), one))
        if not missed.isEmpty():
            links, groups = linked(missed, sets, links)
    shared = written(same_id(usable, nodes))
    if not shared.isEmpty():
        groups = written(components(links.unionByName(shared)))
    first = groups.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    member = groups.join(first, "component").select("node", "least")
    named = nodes.select("digest", "node", "doc_id").join(member, "node", "left").select("digest", F.coalesce("least", "doc_id").alias("group"))
    slim, single = rows.select("doc_id", "n_shingles", "digest"), F.col("digest").isNull() | F.col("doc_id").isNull()
    out = slim.filter(~single).join(named, "digest").select("doc_id", "n_shingles", F.col("group").alias("component_id"))
    out = out.unionByName(slim.filter(single).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(list_transform(g, lambda x: hash(x))) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept FROM s JOIN r ON r.a = s.doc_id
"""
