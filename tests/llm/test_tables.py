"""URL filter, mixing, language-model scores, packing, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import make_docs, words
from valuegrain.llm import backoff_lm, mixing, packing, tokens, url_filter
from valuegrain.llm.common import shrink_heaps, written

# ------------------------------------------------------------------ URLs


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/71?x=1#y", "http://a.example.com/en/8", "https://com/en/", "http://xcom/en/", "http://b.net/de/1",
    "http://m.example.net/de/81", "http://example.net/de/9", "http://É.org/es/1", "http://a.org?x=/es/", "http://a.org#/es/", "http://a.org/es", "x://y://com/en/", "http://a.com/en/\n7", "http://ÀB.com/En/1",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), URLS[r["page_id"]]
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        host = f"{rng.choice(['www', 'm'])}.{'cheap-' if bad else ''}{rng.choice(['pills', 'news', 'shop'])}{rng.randrange(5)}.site.io"
        rows.append((i, f"http://{host}/p/{rng.randrange(900)}"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in range(600))
    assert got[400]["mined_rule"] == ["word=cheap"] and got[400]["mined_confidence"] == 1.0


def test_mined_rules_of_a_sample_of_rows(spark):
    """Of more rows than are mined, rows of one token set stay in proportion, good and bad."""
    hosts = ["cheap-pills.io", "news.io", "mixed.io"]
    rows = [(3 * i + k, f"http://{h}/en/{i}", k != 0 and not (k == 2 and i % 10 < 7)) for i in range(2000) for k, h in enumerate(hosts)]
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    frame = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    labelled = frame.select(F.struct("page_id", "url").alias("row"), url_filter.url_tokens(F.col("url"), host, path).alias("tokens"), (~F.col("good")).alias("bad"))
    assert labelled.select("tokens").distinct().count() == 3
    for most in (600, 1500, 3000):
        found = {tuple(r["items"]): r for r in url_filter.mine_rules(labelled, max_labelled=most).collect()}
        pills, mixed = found["host=cheap-pills",], found["host=mixed",]
        assert pills["rule_confidence"] == 1.0 and abs(pills["rule_support"] / (most / 3) - 1) < 0.25
        assert abs(mixed["rule_confidence"] - 0.7) < 0.1
        assert ("host=news",) not in found


def test_inverted_index_against_brute_force(spark):
    rng = random.Random(8)
    sets = [rng.sample("abcdefgh", rng.randint(0, 6)) for _ in range(60)]
    rules = [(sorted(rng.sample("abcdefgh", rng.randint(1, 3))), rng.random(), 5) for _ in range(12)]
    rules = list({tuple(r[0]): r for r in rules}.values())
    urls = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "row long, tokens array<string>")
    frame = spark.createDataFrame(rules, "items array<string>, rule_confidence double, rule_support long")
    got = {r["row"]: r["rule_confidence"] for r in url_filter.match_rules(urls, frame).collect()}
    want = {i: max(c for items, c, _ in rules if set(items) <= set(s)) for i, s in enumerate(sets) if any(set(r[0]) <= set(s) for r in rules)}
    assert got == want
    assert url_filter.match_rules(urls, frame.limit(0)).count() == 0


# ------------------------------------------------------------------ mixing


def brute_mix(rows):
    """Targets by sharing again and again; selection by sorting each source."""
    size = Counter()
    for _, s, n, _ in rows:
        size[s] += n
    sources = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = dict.fromkeys(sources, 0.0), 1.5 * sum(size.values()), set(sources)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= 2 * size[s]}
        if not full:
            for s in open_:
                target[s] += share * weight[s]
            break
        for s in full:
            left -= 2 * size[s] - target[s]
            target[s] = 2 * size[s]
        open_ -= full
    taken = {}
    for s in sources:
        own = [r for r in rows if r[1] == s]
        u = lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        epochs = int((target[s] + 1e-6) // size[s]) if size[s] else 0
        budget = round(target[s]) - epochs * size[s]
        for i, _, n, w in sorted(own, key=lambda r: (-(u(r[0]) ** (1 / r[3])), r[0])):
            part = max(0, min(n, budget))
            budget -= n
            taken[i] = (epochs * n + part, target[s])
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", None, f"s{i % 9}"]), rng.choice([0, 1, rng.randint(2, 300)]), rng.choice([0.1, 0.5, 1.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    got = {r["doc_id"]: (r["taken"], r["target"]) for r in mixing.mix(df).collect()}
    want = brute_mix(rows)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(math.isclose(got[i][1], want[i][1], rel_tol=1e-9) for i in got)
    again = {r["doc_id"]: (r["taken"], r["target"]) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == got and all(got[i][0] <= 2 * n for i, _, n, _ in rows)


def test_mix_edges(spark, docs, no_docs, prose):
    assert mixing.mix(mixing.sized_documents(no_docs)).count() == 0
    got = {r["doc_id"]: r for r in mixing.mix(mixing.sized_documents(docs)).collect()}
    assert {i: r["size"] for i, r in got.items()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(prose)}
    total = sum(r["size"] for r in got.values())
    assert abs(sum(r["taken"] for r in got.values()) - 1.5 * total) <= 3
    blank = mixing.mix(mixing.sized_documents(make_docs(spark, [None, " "], sources=[None, "x"]))).collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0), (0.0, 0)]


# ------------------------------------------------------------------ language-model scores


def brute_backoff(texts, order=3):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every, words_ = sum(map(grams, docs), Counter()), sum(map(len, docs))
    out = []
    for w in docs:
        own, total, backs = grams(w), 0.0, 0
        seen = lambda g: every[g] - own[g]  # noqa: E731, B023
        for i in range(len(w)):
            most = min(order - 1, i)
            for k in range(most, -1, -1):
                g = tuple(w[i - k : i + 1])
                if k and seen(g) > 0:
                    p = seen(g) / seen(g[:-1])
                    break
                if not k:
                    p = (seen(g) or 0.5) / max(words_ - len(w), 1)
            total += math.log10(p) + (most - k) * math.log10(0.4)
            backs += most > k
        out.append((len(w), backs, total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(docs, prose, order):
    got = {r["doc_id"]: r for r in backoff_lm.stupid_backoff(docs, order).collect()}
    for i, (n, backs, total) in enumerate(brute_backoff(prose, order)):
        assert (got[i]["n_words"], got[i]["n_backoff"]) == (n, backs) and math.isclose(got[i]["log10_score"], total, abs_tol=1e-6)


def test_backoff_over_many_blocks(docs, prose, monkeypatch, no_docs):
    monkeypatch.setattr(backoff_lm, "BLOCK_CHARS", 5000)
    got = {r["doc_id"]: r["log10_score"] for r in backoff_lm.stupid_backoff(docs).collect()}
    assert all(math.isclose(got[i], t, abs_tol=1e-6) for i, (_, _, t) in enumerate(brute_backoff(prose)))
    assert backoff_lm.stupid_backoff(no_docs).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for x in ([], [0], [5], [2**63 + 5], sorted(rng.integers(0, 2**40, 500).tolist())):
        x = np.array(x, np.uint64)
        assert (backoff_lm.unpack_sorted(backoff_lm.pack_sorted(x)) == x).all()
    for c in ([], [1, 254, 255, 256, 2**40], [0]):
        c = np.array(c, np.int64)
        assert (backoff_lm.unpack_counts(backoff_lm.pack_counts(c)) == c).all()


# ------------------------------------------------------------------ packing


def test_ids_are_the_tokenizers(prose):
    enc = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(1)
    letters = "abcXYZ ÀéßŸſŉŁ'_0123 \n\t.,!?-–—“”…€²½İΣςÁ 中文ᴬªº\x1c\x85\u200b"
    texts = [t or "" for t in prose] + ["".join(rng.choice(letters) for _ in range(30)) for _ in range(800)] + ["a <|endoftext|> b", "it's they'll 've", "x" * 500]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [e.ids for e in enc.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc(part)] == want


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHE", 20)
    monkeypatch.setattr(tokens, "STALE", 2)
    enc, rng = tokens.Encoder(tokens.tokenizer_path()), random.Random(2)
    for _ in range(30):
        t = [words(rng, 20) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc(t)] == [e.ids for e in enc.tokenizer.encode_batch(t, add_special_tokens=False)]


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.random((8, 15)), rng.random(8)
        x, y = packing.nnls(a, b), np.zeros(15)
        for _ in range(20_000):
            y = np.maximum(y - a.T @ (a @ y - b) / np.linalg.norm(a, 2) ** 2, 0)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_patterns_fill_sequences():
    found = packing.patterns(8, 3)
    assert all(sum(p) == 8 and len(p) <= 3 and list(p) == sorted(p, reverse=True) for p in found) and len(set(found)) == len(found) == 10


@pytest.mark.parametrize("case", ["many", "few", "equal", "full", "large", "none"])
def test_plan(case):
    rng = np.random.default_rng(4)
    counts = np.zeros(4097, np.int64)
    lengths = {"many": np.minimum(rng.lognormal(6.3, 1, 20_000).astype(int) + 1, 4096), "few": np.array([4000, 97, 96, 1]), "equal": np.full(1000, 1000), "full": np.full(7, 4096), "large": np.array([2049] * 9), "none": np.array([], int)}[case]
    np.add.at(counts, lengths, 1)
    for share in packing.SHARES:
        plan = packing.Plan(counts, share=share)
        ranks, used = {}, {}
        for length, rank, n, first, offset in sorted(plan.runs):
            assert ranks.get(length, 0) == rank
            ranks[length] = rank + n
            for k in range(n):
                used.setdefault(first + k, []).append((offset, length))
        assert ranks == {int(x): int(counts[x]) for x in np.flatnonzero(counts)} and len(used) == plan.sequences
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
    best = min(packing.Plan(counts, share=s).sequences for s in packing.SHARES)
    bound = -(-int(lengths.sum()) // 4096)
    assert best <= {"many": bound * 1.005 + 1, "few": 2, "equal": 250, "full": 7, "large": 9, "none": 0}[case]


def brute_pieces(texts, limit=4096):
    enc, out = tokens.Encoder(tokens.tokenizer_path()).tokenizer, {}
    for i, t in enumerate(texts):
        ids = enc.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            out[i, k // limit] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def sequences_are_whole(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    return len(by)


def test_pack(docs, no_docs, prose):
    rows = packing.pack(packing.token_pieces(docs)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == brute_pieces(prose)
    assert len(rows) == len(brute_pieces(prose))
    assert sequences_are_whole(rows) <= -(-sum(r["length"] for r in rows) // packing.LIMIT) + 1
    assert packing.pack(packing.token_pieces(no_docs)).count() == 0
    with_ids = packing.token_pieces(docs.filter("doc_id = 0"), with_ids=True).first()
    assert zlib.crc32(bytes(with_ids["ids"])) == with_ids["ids_crc32"]


# ------------------------------------------------------------------ the pipeline


def test_pipeline_stages(spark, docs, prose, tmp_path):
    """Each stage on what the one before kept, against brute force."""
    from tests.llm.test_dedup import brute_exact, brute_near

    frames, out = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, "").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == docs.columns
        frames[name] = out.collect()
    ids = lambda name: sorted(r["doc_id"] for r in frames[name])
    lettered = [i for i, t in enumerate(prose) if any(c.isalpha() for c in t or "")]
    assert ids("language_id") == lettered
    exact = brute_exact([(i, prose[i]) for i in lettered])
    assert ids("exact_dedup") == [i for i in lettered if exact[i][2]]
    near = brute_near([(i, prose[i]) for i in ids("exact_dedup")])
    assert ids("near_dedup") == sorted(i for i, x in near.items() if x[2])
    left = {i: prose[i] for i in ids("near_dedup")}
    mixed = {r["doc_id"]: r for r in mixing.mix(mixing.sized_documents(docs.filter(F.col("doc_id").isin(list(left))))).collect()}
    times = Counter(ids("source_mix"))
    assert times == {i: n for i, r in mixed.items() if (n := int((r["taken"] + r["size"] / 2) // r["size"]))}
    assert all(r["text"] == prose[r["doc_id"]] for r in frames["source_mix"])
    pieces = brute_pieces(prose)
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in frames["packing"])
    assert got == {(*k, *v): times[k[0]] for k, v in pieces.items() if k[0] in times}
    sequences_are_whole(frames["packing"])


def test_pipeline_keeps_texts_where_no_language_can_be_learned(spark, docs, prose):
    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.tell_language(spark, nameless, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(prose) if any(c.isalpha() for c in t or "")]


def test_pipeline_drops_texts_whose_language_is_not_told(spark):
    """F1: the network's score decides, and what it drops is missing in the stages that follow."""
    rng, alphabets = random.Random(8), ["abcde", "fghij", "klmno", "pqrst"]
    plain = [words(rng, 60, alphabets[i % 4]) for i in range(120)]
    mixed = [" ".join(words(rng, 15, a) for a in alphabets) for _ in range(6)]
    docs = make_docs(spark, plain + mixed, langs=[alphabets[i % 4] for i in range(120)] + [None] * 6)
    told = written(corpus_pipeline.tell_language(spark, docs, ""))
    assert sorted(r["doc_id"] for r in told.collect()) == list(range(120))
    assert sorted(r["text"] for r in corpus_pipeline.drop_exact_copies(spark, told, "").collect()) == sorted(plain)


def test_heaps_shrink_where_allowed(spark):
    gc = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    before = gc()
    shrink_heaps(spark)
    assert gc() > before


def test_pipeline_keeps_texts_of_repeated_and_missing_ids(spark):
    rng = random.Random(4)
    a, b, c, d, e = (words(rng, 40) for _ in range(5))
    docs = make_docs(spark, [a, b, a + " ", c, c, d, d, e, "1 2"], ids=[5, 5, 6, None, None, 7, None, None, None], sources=["s"] * 9)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") >= 0, F.col("doc_id")))
    out, norm = docs, lambda rows: sorted((r["doc_id"] or 0, r["text"].strip()) for r in rows)
    want = sorted([(0, c), (0, e), (5, b), (6, a), (7, d)])
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = written(stage(spark, out, ""))
        assert out.columns == docs.columns
        if name != "language_id":
            assert norm(out.collect()) == want, name
    mixed = norm(corpus_pipeline.mix_sources(spark, out, "").collect())
    assert set(mixed) == set(want) and 6 <= len(mixed) <= 9  # 1.5 times the words, so each once at least


def test_pipeline_runs_on_files_and_on_nothing(spark, docs, no_docs, tmp_path):
    for name, d in (("some", docs.limit(12)), ("none", no_docs)):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(rows) == (name == "some")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "packing"]
