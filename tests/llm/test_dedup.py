"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make_docs, words
from valuegrain.llm import exact_dedup, near_dedup
from valuegrain.llm.common import written
from valuegrain.llm.components import components


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def told(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


def test_exact(docs, prose):
    assert told(exact_dedup.exact_dedup(docs)) == brute_exact(list(enumerate(prose)))


def test_exact_survives_digest_collisions(docs, prose):
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)  # noqa: E731  16 digests for all texts
    assert told(exact_dedup.exact_dedup(docs, digest=weak)) == brute_exact(list(enumerate(prose)))


def test_exact_edges(spark, no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    twice = make_docs(spark, ["a", "a", "a b"], ids=[5, 5, None])
    rows = exact_dedup.exact_dedup(twice).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows] == [(None, None, 1, True), (5, 5, 2, True), (5, 5, 2, True)]


def test_exact_reads_files_and_folders(spark, tmp_path, docs, prose):
    slim = docs.select("doc_id", "text")
    slim.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert told(exact_dedup.op8_exact_dedup(spark, str(tmp_path))) == brute_exact(list(enumerate(prose)))
    slim.toPandas().to_parquet(tmp_path / "one.parquet")
    assert exact_dedup.stream_of(spark, str(tmp_path / "one.parquet")).isStreaming


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}


def test_near(docs, prose):
    assert near(docs) == brute_near(list(enumerate(prose)))


def test_near_in_a_dense_region(spark):
    """Near copies of one text, and many texts that share a long passage but little else."""
    rng = random.Random(9)
    base = words(rng, 150).split()
    texts = []
    for _ in range(80):
        v = list(base)
        for _ in range(rng.randint(1, 4)):
            v[rng.randrange(len(v))] = words(rng, 1)
        texts.append(" ".join(v))
    passage = words(rng, 60)
    texts += [f"{words(rng, 50)} {passage} {words(rng, 40)}" for _ in range(80)]
    assert near(make_docs(spark, texts)) == brute_near(list(enumerate(texts)))


def planted_crowd(seed=3, size=300, pairs=40):
    """Texts that share a passage at similarities of 0.6 to 0.74, and pairs of them at 0.75 to 0.8."""
    rng = random.Random(seed)
    passage, texts = words(rng, 120), []
    for _ in range(size):
        texts.append(f"{passage} {words(rng, rng.randint(24, 34))}")
    for _ in range(pairs):
        own = words(rng, 29).split()
        texts.append(f"{passage} {' '.join(own)}")
        near = [*own[:11], *words(rng, 18).split()]
        texts.append(f"{passage} {' '.join(near)}")
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("counted", [near_dedup.COUNTED_NODES, 0])
def test_near_pairs_planted_in_a_crowd(spark, monkeypatch, counted):
    monkeypatch.setattr(near_dedup, "COUNTED_NODES", counted)
    texts = planted_crowd()
    want = brute_near(list(enumerate(texts)))
    assert len({x[1] for x in want.values()}) <= len(texts) - 30  # the pairs, and little else, are linked
    assert near(make_docs(spark, texts)) == want


def test_first_shingles_meet():
    rng = np.random.default_rng(7)
    common, counts = np.arange(0, 300, 3, dtype=np.uint64), rng.integers(2, 50, 100)
    met = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 300, rng.integers(1, 9)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            met += 1
            assert len(np.intersect1d(*(near_dedup.first_shingles(s, common, counts) for s in (a, b))))
    assert met > 100


def test_near_edges(spark, no_docs):
    assert near(no_docs) == {}
    got = near_dedup.near_duplicates(make_docs(spark, ["a b", "a b", "A B", None], ids=[9, 9, None, 3])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("3", "3", True), ("9", "9", True), ("9", "9", True), ("None", "None", True)]


def test_forest_pairs_cover_every_seam():
    """Cut anywhere, the pairs within the parts and across the seam include those of the whole."""
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 3, (60, 1 + near_dedup.DEPTH)), axis=0)
    keys = keys[np.lexsort(keys.T[::-1])]
    i, j = near_dedup.forest_pairs(keys, np.arange(60))
    assert (keys[i][:, : near_dedup.MIN_DEPTH + 1] == keys[j][:, : near_dedup.MIN_DEPTH + 1]).all()
    adjacent = {(k, k + 1) for k in range(59) if (keys[k, : near_dedup.MIN_DEPTH + 1] == keys[k + 1, : near_dedup.MIN_DEPTH + 1]).all()}
    assert adjacent <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**62, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2700], rng.integers(0, 2**62, 300).astype(np.uint64)]))
    x, y = (np.frombuffer(near_dedup.signature(s), ">u2") for s in (a, b))
    assert abs((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"chain": [(k, k + 1) for k in range(120)], "star": [(500, k) for k in range(100)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]}[shape]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_written_lands_in_the_shared_folder(spark, docs):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert all(f.startswith(base) for f in written(docs.select("doc_id")).inputFiles())


def test_near_repeated_ids_with_other_texts(spark):
    """A document with two texts is linked with what either is near to."""
    rng = random.Random(11)
    a, b, c = (" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(3))
    df = make_docs(spark, [a, b, a + " more", b + " more", c, c + " end", a], ids=[1, 1, 2, 3, 4, 9, 8])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (8, 1, False), (9, 4, False)]
