"""Row-wise operators: line labels, page text, language, quality."""

import itertools
import random
import time

import numpy as np
import pytest

from tests.llm.conftest import make_docs, words
from valuegrain.llm import html_lstm, language_gru, line_crf, quality_nbsvm
from valuegrain.llm.html_blocks import read_blocks


# ------------------------------------------------------------------ line labels


def brute_base(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


TEXTS = [None, "", " \n ", "a b a b a b a", "x\ny\nx\n\n\n", "é ü ß|<>", "a b c", "same same same same same", "l1 #$\nl1 #$\nl2", "the cat sat the cat sat on the mat"]


@pytest.mark.parametrize("text", [*TEXTS, words(random.Random(1), 300, "ab")])
def test_base_figures(text):
    assert line_crf.analyse(text)[0] == brute_base(text)


def test_viterbi_and_likelihood_against_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 6):
        u, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        score = lambda y: sum(u[i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(line_crf.viterbi(u, t)) == best
    assert len(line_crf.viterbi(np.zeros((0, 2)), t)) == 0


def quality_docs(spark):
    rng = random.Random(4)
    good = ["\n".join(words(rng, 25) + "." for _ in range(5)) for _ in range(60)]
    bad = ["\n".join(" ".join(w + "***" for w in words(rng, 25).split()) for _ in range(5)) for _ in range(40)]
    texts = good + bad + [None, "", good[0] + "\n" + bad[0]]
    docs = make_docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_line_quality(spark, no_docs):
    docs, labels = quality_docs(spark)
    model = line_crf.train_line_model(docs, labels)
    got = {r["doc_id"]: r for r in line_crf.line_quality(docs, model).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 102))
    assert 0.4 < got[102]["content_share"] < 0.6 and got[100]["base_failed"] and got[101]["n_words"] == 0
    assert line_crf.line_quality(no_docs, model).count() == 0
    neutral = line_crf.train_line_model(docs, labels.limit(0))
    assert not neutral[0].any() and [r["kept"] for r in line_crf.line_quality(docs, neutral).filter("doc_id IN (0, 100)").orderBy("doc_id").collect()] == [True, False]


# ------------------------------------------------------------------ page text


def test_blocks():
    got = [(b.path, b.text) for b in read_blocks('<div class="a b">x &lt; 3 <b>y<p>z<br>w</p><li>q</div> < 5 <a href="u>v">l</a>')]
    assert got == [(("div", ".a", ".b"), "x < 3 y"), (("div", ".a", ".b", "b", "p"), "z w"), (("div", ".a", ".b", "b", "li"), "q"), ((), "< 5 l")]
    assert [b.text for b in read_blocks('<script>var t="</p>";x("<p>no")</script><style>p{}</style><p>yes &amp; no<!-- <p>c</p> -->')] == ["yes & no"]
    for page in (None, "", "<", "<p", "<!--", "<script>", "</div>", "<p><p><p>", "<a " * 2000, "&#0;"):
        read_blocks(page)


@pytest.mark.parametrize(("page", "want"), [
    ('<article><p>before</p><svg><path d="x"><p>after one</p><p>after two</p>', ["before", "after one", "after two"]),
    ("<p>a <math><mi>x</mi><mo>+</mo></math> b</p>", ["a x+ b"]),
    ("<noscript><p>main</p></noscript>", ["main"]),
    ('<object data="x"><p>rest</p>', ["rest"]),
    ("<template><p>a</p><template>b</template><p>c</p></template><p>d</p>", ["d"]),
    ("<script/>code</script><p>d</p>", ["d"]),
    ("<script>code<p>more", []),
    ("""<a title="it's > that">link end</a>""", ["link end"]),
    ("<p>it's 5 > 3 <b class='x>y'>z</b></p>", ["it's 5 > 3 z"]),
    ("<select><option>a</select><p>z<select><p>y", ["z", "y"]),
    ("<textarea><p>q</p></textarea>m<textarea><p>n", ["m", "n"]),
    ("<svg/><p>x</p><svg><svg></svg><g>y</g></svg>", ["x"]),
    ("<head><title>x</title></head><body>b", ["b"]),
    ("<head><body>b</body>", ["b"]),
])
def test_blocks_of_unclosed_and_nested_elements(page, want):
    assert [b.text for b in read_blocks(page)] == want


@pytest.mark.parametrize("page", ["<svg>" * 30_000, "<svg>" * 30_000 + "</svg>", "<textarea>" * 30_000, '<p a="' + "x> " * 100_000, "<p " + 'a="1" ' * 50_000, "<p a='" * 30_000])
def test_odd_pages_take_linear_time(page):
    began = time.time()
    read_blocks(page)
    assert time.time() - began < 5


def test_blocks_hold_what_another_parser_reads():
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "svg", "template", "select", "textarea")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "svg", "template", "select", "textarea")

        def handle_data(self, data):
            if not self.skip:
                self.out += data.split()

    rng = random.Random(3)

    def some(depth):
        kind = rng.choice(["p", "div", "ul", "b", "a", "svg", "script", "math", "object", "noscript", "template", "select", "textarea", "section"])
        if kind in ("script", "textarea"):
            return f"<{kind}>w{rng.randrange(99)}</{kind}>"
        inner = "".join(rng.choice([f" w{rng.randrange(99)} &amp; ", some(depth + 1)]) if depth < 4 else " leaf " for _ in range(rng.randrange(1, 4)))
        return f"<{kind} title='a>b' class=\"{rng.choice('xyz')}\">{inner}</{kind}>"

    for _ in range(300):
        page = "<body>" + some(0) + some(0) + "</body>"
        reader = Texts()
        reader.feed(page)
        assert " ".join(b.text for b in read_blocks(page)).split() == reader.out, page


def test_gradients_of_the_block_labeller():
    rng = np.random.default_rng(1)
    net = html_lstm.Labeller(rng.normal(0, 0.3, (html_lstm.PATH_SLOTS, html_lstm.DIM)).astype(np.float32), rng.normal(0, 0.3, (html_lstm.WORD_SLOTS, html_lstm.DIM)).astype(np.float32), [rng.normal(0, 0.3, (4 * html_lstm.HIDDEN, 2 * html_lstm.DIM + html_lstm.FIGURES + html_lstm.HIDDEN + 1)).astype(np.float32) for _ in range(2)], rng.normal(0, 0.3, 2 * html_lstm.HIDDEN + 1).astype(np.float32))
    blocks = read_blocks("<div><p>one two</p><ul><li>three</li></ul><p>four</p></div>")
    row = (*html_lstm.slots(blocks, {}), html_lstm.figures(blocks), np.array([1, 0, 1], np.float32))

    class Keep:  # drops nothing
        def random(self, n):
            return np.ones(n)

    grads = html_lstm._gradients(net, [row], Keep())

    def loss():
        x = np.hstack([html_lstm._mean(net.path, row[0], row[1], 3), html_lstm._mean(net.word, row[2], row[3], 3), row[4]])[:, None]
        z = net.forward(x.astype(np.float32), np.ones((3, 1), np.float32))[:, 0].astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(row[5] > 0, z, -z)))))

    for p, g in zip([net.path, *net.gates, net.out], [grads[0], *grads[2:4], grads[4]], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[at], 1e-2
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 0.02 * max(0.05, abs(g[at])) + 1e-3


def test_page_text(spark):
    net = html_lstm.train()
    rng = np.random.default_rng(123)  # pages that training has not seen
    right = wrong = 0
    for _ in range(60):
        page, main = html_lstm.make_page(rng)
        blocks = read_blocks(page)
        got = set(net.main_text([blocks], {})[0].split("\n")) - {""}
        want = {b.text for b in blocks if b.text in main}
        right, wrong = right + len(got & want), wrong + len(got ^ want)
    assert wrong < 0.03 * right
    page = (
        '<html><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>On rivers</h1><p>Rivers   run\nto the sea, and carry sand &amp; silt.</p>'
        '<p>They bend.</p></article><section class="comments"><p>Nice text, thanks for sharing it with us.</p></section><footer>&copy; 2024</footer></body></html>'
    )
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<p>" + "word " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_lstm.extract(pages, net).collect()), key=str)
    want = "On rivers\nRivers run to the sea, and carry sand & silt.\nThey bend."
    assert got[0] == (0, "", 0) and got[1] == got[2] == (1, want, len(want)) and got[3] == (2, "", 0)
    assert html_lstm.extract(pages.limit(0), net).count() == 0


# ------------------------------------------------------------------ language


def test_gradients_of_the_language_network():
    rng = np.random.default_rng(2)
    n3, h = 3 * language_gru.HIDDEN, language_gru.HIDDEN
    new = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    net = language_gru.Gru(["a", "b"], language_gru.Direction(new(n3, 256), new(n3, h)), language_gru.Direction(new(n3, 256), new(n3, h)), new(2, 2 * h), np.zeros((2, 1), np.float32))
    x, live, y = rng.integers(0, 4, (5, 3)).astype(np.uint8), np.ones((5, 3), np.float32), np.array([0, 1, 0])
    live[4, 1] = 0
    grads = language_gru._gradients(net, x, live, y)

    def loss():
        s = net.states(x, live).reshape(2 * h, -1)
        z = (net.out @ s + net.bias).astype(float)
        p = np.exp(z - z.max(0))
        p = (p / p.sum(0)).reshape(2, 5, 3)
        return float(-(np.log(p[y, :, np.arange(3)]).T * live).sum() / live.sum())

    for p, g in zip([net.ahead.table, net.ahead.own, net.back.table, net.back.own, net.out, net.bias], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[at], 1e-2
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_language(spark, no_docs):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(20, 80), "abcdefgh") for _ in range(80)] + [words(rng, rng.randint(20, 80), "mnopqrst") for _ in range(80)]
    odd = [None, "", "123 ,.- 77", "中文 字", words(rng, 20_000, "abcdefgh")]
    docs = make_docs(spark, texts + odd, ["aa"] * 80 + ["mm"] * 80 + [None] * 5)
    got = {r["doc_id"]: r for r in language_gru.predict(docs, language_gru.train(docs)).collect()}
    assert np.mean([got[i]["lang_pred"] == ("aa" if i < 80 else "mm") for i in range(160)]) > 0.97
    held = [i for i in range(160) if got[i]["held_out"]]
    assert held and all(got[i]["lang_pred"] == ("aa" if i < 80 else "mm") for i in held)
    assert [got[160 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[160]["score"] == 0
    assert got[163]["lang_pred"] in ("aa", "mm") and got[164]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_gru.predict(no_docs, language_gru.train(no_docs)).count() == 0
    alone = language_gru.train(docs.filter("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_gru.predict(docs, alone).collect()} == {"aa", "und"}


def test_language_is_learned_beyond_a_header(spark):
    rng = random.Random(2)
    header = words(rng, 400, "uvwxyz")
    assert len(header) > language_gru.TRAIN_CHARS
    own = [words(rng, 2000, "abcdefgh" if i % 2 else "mnopqrst") for i in range(60)]
    net = language_gru.train(make_docs(spark, [f"{header} {t}" for t in own], ["aa" if i % 2 else "mm" for i in range(60)]))
    got = language_gru.predict(make_docs(spark, own), net).collect()
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "mm") for r in got)


def test_long_texts_count_whole():
    """A document's probabilities are the means over all its segments."""
    net = language_gru.fit({"a": [b"aaab" * 20], "b": [b"bbba" * 20]}, steps=30)
    parts = [b"a" * 128, b"b" * 128, b"ab" * 30]
    each = net.documents(parts) * np.array([[128], [128], [60]])
    assert np.allclose(net.documents([b"".join(parts)])[0], each.sum(0) / 316, atol=1e-5)
    assert net.documents([b""]).tolist() == [[0.0, 0.0]]


# ------------------------------------------------------------------ quality


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = [(np.sort(rng.choice(50, 5, replace=False)), rng.normal(size=5)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1, -1)
    w, b = quality_nbsvm.dual_descent(x, y, np.ones(60), epochs=500)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - s * (w[i] @ v + b)) for (i, v), s in zip(x, y, strict=True))

    best = primal(w, b)
    for _ in range(200):
        d = np.zeros_like(w)
        d[:50] = rng.normal(0, 0.01, 50)
        assert primal(w + d, b + rng.normal(0, 0.01)) >= best - 1e-6


def test_quality(spark, no_docs):
    docs, labels = quality_docs(spark)
    got = {r["doc_id"]: r for r in quality_nbsvm.score(docs, quality_nbsvm.train(docs, labels)).collect()}
    held = [i for i in range(100) if got[i]["held_out"]]
    assert len(held) > 5 and all(got[i]["predicted"] == int(i < 60) for i in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[100]["score"] == got[101]["score"]
    assert quality_nbsvm.score(no_docs, quality_nbsvm.train(docs, labels)).count() == 0
    blank = quality_nbsvm.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_nbsvm.score(docs, blank).collect()} == {0.5}


def test_grams_are_distinct_hashes_of_all_positions():
    g = quality_nbsvm.Grams()
    a, b = g("abcabc"), g("abc")
    assert len(set(a.tolist())) == len(a) and set(b[b < quality_nbsvm.SIZE].tolist()) & set(a.tolist())
    assert len(g(None)) == len(g("")) == 0 and not g.buffer.any()
