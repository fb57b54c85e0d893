"""Main-text extraction: a bidirectional LSTM labels every leaf block of a page.

A block's input is the mean of the hashed vectors of its tag path (tags, class, id and role
words), the mean of the hashed vectors of its words, and a few figures (length, share of link
text, marks).  Both directions read the page's whole block sequence, so each label uses
document-wide context.  Numpy only.

Training pages are made up here from page layouts (``make_page``): article bodies under many
container names amid menus, headers, side columns, notices, adverts, forms, footers and reader
comments; their labels are known.  Nothing is learned from the pages that are extracted, so the
model is the same for every input.  Extraction is row by row on the executors: no shuffle.

Defined results: null or empty html, and pages without a main block, give empty text; every block
of any length counts; repeated rows are extracted alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, small_batches, table
from .html_blocks import Block, read_blocks

PATH_SLOTS, WORD_SLOTS = 4096, 2048
DIM, HIDDEN, FIGURES = 12, 12, 10
F4 = np.float32
#: Blocks of several pages that run together; a longer page runs alone.
BATCH_BLOCKS = 40_000

MAIN = "article main content post entry body story text page single detail prose".split()
BOX = "wrapper container row col inner outer layout site grid section area block holder".split()
JUNK = {
    "nav": ("nav", "nav menu navigation navbar topnav links breadcrumb breadcrumbs pagination pager toc tabs skip"),
    "header": ("header", "header masthead branding logo banner top tagline topbar hero"),
    "footer": ("footer", "footer foot copyright legal bottom colophon credits sitemap"),
    "aside": ("aside", "sidebar side aside widget related recommended popular trending rail secondary tags teaser more"),
    "ad": ("div", "ad ads advert advertisement sponsor sponsored promo promoted promotion adsense banner dfp"),
    "notice": ("div", "notice cookie cookies consent gdpr alert warning popup modal overlay message disclaimer paywall toast"),
    "form": ("form", "form search login signup subscribe newsletter contact register input field"),
    "comments": ("section", "comments comment discussion reply replies respond thread responses disqus feedback reviews"),
    "share": ("div", "share social sharing follow toolbar buttons actions meta byline author bio avatar"),
    "hidden": ("div", "hidden"),
}
SMALL = "Home About Contact Login Search Menu News Blog Help Terms Privacy Next Previous Share Tweet Reply Subscribe More Top".split()
SAYS = {
    "ad": ["Advertisement", "Sponsored content", "Buy now and save", "Special offer"],
    "notice": ["We use cookies to improve your experience", "Accept all", "By continuing you agree to our terms", "Please enable scripts"],
    "footer": ["© {y} {w}", "All rights reserved.", "Terms of use · Privacy", "Copyright {y} {w}"],
    "form": ["Enter your email address", "Your name", "Send", "Sign up for our newsletter", "Search"],
    "comments": ["Comments", "3 replies", "Leave a reply", "{w} says:", "Posted by {w} on {y}"],
    "share": ["Share this", "Follow us", "By {w}", "Filed under {w}"],
    "hidden": ["Skip to content"],
}


def slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


# ---------------------------------------------------------------- made-up training pages


def _prose(rng: np.random.Generator, n: int) -> str:
    letters = "etaoinshrdlucmfwypvbgkéèàöüßñç"
    words = ["".join(letters[k] for k in np.minimum(rng.geometric(0.09, rng.integers(2, 9)) - 1, len(letters) - 1)) for _ in range(n)]
    for i in range(0, n, int(rng.integers(6, 15))):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += "."
    odd = rng.random()  # rough writing is still main text
    if odd < 0.05:
        words = [w + str(rng.choice(["***", "###", "%%%", "!!"])) for w in words]
    elif odd < 0.11:
        return " | ".join(words) + str(rng.choice([" |", "", "."]))
    elif odd < 0.15:
        words = [w for w in words[: n // 5 + 1] for _ in range(rng.integers(2, 8))]
    elif odd < 0.18:
        words = [w.upper() for w in words]
    return " ".join(words) + str(rng.choice([".", ".", ".", "", "!", ":"]))


def make_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks; block texts are unique on the page."""
    main: set[str] = set()
    used: set[str] = set()
    pick = lambda xs: str(xs[rng.integers(len(xs))])
    bare = rng.random() < 0.35  # no class names

    def text(t: str, good: bool) -> str:
        while t in used or not t:
            t += " " + _prose(rng, 1)
        used.add(t)
        if good:
            main.add(t)
        return t

    def mark(words: list[str], p: float = 0.8) -> str:
        if bare or rng.random() > p:
            return ""
        names = [pick(words) + pick(["", "", "-" + pick(BOX), "-" + pick(words), str(rng.integers(99))]) for _ in range(rng.integers(1, 3))]
        return f' {pick(["class", "class", "id"])}="{" ".join(names)}"'

    def wrap(inner: str, p: float = 0.4) -> str:
        return f"<div{mark(BOX)}>{inner}</div>" if rng.random() < p else inner

    def junk(kind: str) -> str:
        tag, words = JUNK[kind]
        names = words.split()
        plain = rng.random() < 0.5 if kind != "form" else False
        if plain and kind in ("comments", "aside", "ad", "notice", "share", "hidden", "form") or not plain and tag == "div":
            own, attr = "div", f' {pick(["class", "id"])}="{pick(names)}{pick(["", "-" + pick(BOX), "-" + pick(names)])}"'
        else:
            own, attr = tag, mark(names, 0.5)
        if kind == "comments" and own == "section":
            attr = f' {pick(["class", "id"])}="{pick(names)}"'
        if kind == "hidden":
            attr = pick([' style="display:none"', " hidden", ' class="hidden"'])
        out = []
        n = int(rng.integers(1, 7))
        style = rng.random()
        if kind in ("nav", "footer", "aside", "header") and style < 0.65:
            items = [f'<a href="/{i}">{text(pick(SMALL) if rng.random() < 0.4 else _prose(rng, int(rng.integers(1, 5))), False)}</a>' for i in range(n + 2)]
            out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else "".join(wrap(x, 0.3) + pick([" | ", " "]) for x in items[:1]))
        if kind in SAYS and rng.random() < 0.7:
            said = pick(SAYS[kind]).format(y=rng.integers(1999, 2026), w=_prose(rng, 1)[:-1])
            out.append(pick(["<p>{}</p>", "<div>{}</div>", "{}", "<h3>{}</h3>", "<span>{}</span>"]).format(text(said, False)))
        if kind == "comments":
            for i in range(n):
                c = text(_prose(rng, int(rng.integers(3, 60))), False)
                out.append(pick([f'<div class="{pick(names)}"><p>{c}</p></div>', f"<li>{c}</li>", f"<p>{c}</p>", f'<article class="comment">{c}</article>']))
        if kind == "form":
            out.append(f'<label>{text(_prose(rng, 2), False)}</label><input name="q"><button>{text(pick(SMALL), False)}</button>')
        if not out or rng.random() < 0.5:
            out.append(pick(["<p>{}</p>", "{}", "<div>{}</div>", "<h4>{}</h4>"]).format(text(_prose(rng, int(rng.integers(2, 30))), False)))
        return f"<{own}{attr}>{''.join(out)}</{own}>"

    def body() -> str:
        out = []
        if rng.random() < 0.85:
            title = f"<h1>{text(_prose(rng, int(rng.integers(1, 14))), True)}</h1>"
            out.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
        for _ in range(int(min(40, rng.geometric(0.12)))):
            r = rng.random()
            t = lambda a, b: text(_prose(rng, int(rng.integers(a, b))), True)
            if r < 0.72:
                p = f"<p>{t(1, 90)}"
                out.append(pick([p + "</p>", p + "</p>", p, p.replace("<p>", "<p><b>") + "<br>"]))
            elif r < 0.79:
                out.append(f"<h{rng.integers(2, 5)}>{t(1, 7)}</h2>")
            elif r < 0.86:
                out.append("<ul>" + "".join(f"<li>{t(1, 20)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif r < 0.90:
                out.append(f"<blockquote>{t(5, 40)}</blockquote>")
            elif r < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{t(1, 4)}</td><td>{t(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.94:
                out.append(f"<pre>{t(5, 20)}</pre>")
            elif r < 0.96:
                out.append(f'<p>{text(_prose(rng, 4) + " see", True)[:0]}</p>')
            else:
                out.append(junk(pick(["ad", "share", "aside", "notice", "form"])))
        tag = pick(["article", "article", "main", "div", "div", "section"])
        if bare and tag in ("div", "section"):
            tag = "article" if rng.random() < 0.5 else tag
        attr = f' {pick(["class", "id"])}="{pick(MAIN)}{pick(["", "-" + pick(MAIN), "-" + pick(BOX)])}"' if tag in ("div", "section") and not bare else mark(MAIN, 0.3)
        return f"<{tag}{attr}>{''.join(out)}</{tag}>"

    before = [junk(k) for k in rng.permutation(["nav", "header", "notice", "ad", "aside", "form", "hidden", "nav"])[: rng.integers(0, 5)]]
    after = [junk(k) for k in rng.permutation(["comments", "aside", "share", "footer", "ad", "nav", "form", "notice", "comments"])[: rng.integers(0, 5)]]
    middle = body() if rng.random() < 0.97 else ""
    if rng.random() < 0.3:
        middle = f"<main>{middle}</main>" if rng.random() < 0.5 else wrap(middle, 1)
    page = "".join(before) + middle + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{_prose(rng, 3)}</title></head><body>{wrap(page)}</body></html>", main


# ---------------------------------------------------------------- the network


def figures(blocks: list[Block]) -> np.ndarray:
    out, n = np.zeros((len(blocks), FIGURES), F4), len(blocks)
    for i, b in enumerate(blocks):
        size, words = len(b.text), b.text.count(" ") + 1
        out[i] = (
            np.log1p(size) / 6, np.log1p(words) / 4, min(b.link / size, 1.0), b.text[-1] in ".!?:;\"'”»)", min(b.text.count(".") / words, 1.0),
            min(b.text.count(",") / words, 1.0), sum(map(str.isdigit, b.text)) / size, i / n, len(b.path) / 12, "©" in b.text,
        )
    return out


def slots(blocks: list[Block], memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of path names and words, each with the block they belong to."""
    p, pw, w, ww = [], [], [], []
    for i, b in enumerate(blocks):
        for names, size, out, of in ((dict.fromkeys(b.path), PATH_SLOTS, p, pw), (b.text.lower().split(), WORD_SLOTS, w, ww)):
            for name in names:
                if (k := memo.get((name, size))) is None:
                    k = slot(name, size)
                    if len(memo) < 300_000:
                        memo[name, size] = k
                out.append(k)
                of.append(i)
    return tuple(np.array(x, np.int64) for x in (p, pw, w, ww))


def _mean(vectors: np.ndarray, k: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, vectors.shape[1]), F4)
    if len(k):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.add.reduceat(vectors[k], first) / np.diff(np.r_[first, len(of)])[:, None].astype(F4)
    return out


@dataclass
class Labeller:
    path: np.ndarray  # (PATH_SLOTS, DIM)
    word: np.ndarray  # (WORD_SLOTS, DIM)
    gates: list[np.ndarray]  # per direction (4H, 2 * DIM + FIGURES + H + 1)
    out: np.ndarray  # (2H + 1,)

    def inputs(self, blocks: list[Block], memo: dict) -> np.ndarray:
        p, pw, w, ww = slots(blocks, memo)
        return np.hstack([_mean(self.path, p, pw, len(blocks)), _mean(self.word, w, ww, len(blocks)), figures(blocks)])

    def forward(self, x: np.ndarray, live: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits (T, N) for inputs ``x`` (T, N, D)."""
        size, n, d = x.shape
        s = np.empty((size, n, 2 * HIDDEN), F4)
        for k, g in enumerate(self.gates):
            base = x @ g[:, :d].T + g[:, -1]
            own = g[:, d:-1].T
            h, c = np.zeros((n, HIDDEN), F4), np.zeros((n, HIDDEN), F4)
            for t in range(size) if k == 0 else range(size - 1, -1, -1):
                a = base[t] + h @ own
                i, f, o = (1 / (1 + np.exp(-a[:, j * HIDDEN : (j + 1) * HIDDEN])) for j in range(3))
                u = np.tanh(a[:, 3 * HIDDEN :])
                new = (f * c + i * u) * live[t, :, None]
                tc = np.tanh(new)
                if trace is not None:
                    trace[k, t] = (h, c, i, f, o, u, tc)
                h, c = o * tc * live[t, :, None], new
                s[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        if trace is not None:
            trace["s"] = s
        return s @ self.out[:-1] + self.out[-1]

    def main_text(self, pages: list[list[Block]], memo: dict) -> list[str]:
        """The main text of each page; pages of like length run together."""
        out = [""] * len(pages)
        order = sorted((len(b), k) for k, b in enumerate(pages) if b)
        while order:
            size, take = order[-1][0], 1
            while take < len(order) and size * (take + 1) <= BATCH_BLOCKS:
                take += 1
            group, order = [k for _, k in order[-take:]], order[:-take]
            x, live = np.zeros((size, len(group), 2 * DIM + FIGURES), F4), np.zeros((size, len(group)), F4)
            for j, k in enumerate(group):
                x[: len(pages[k]), j], live[: len(pages[k]), j] = self.inputs(pages[k], memo), 1
            y = self.forward(x, live) > 0
            for j, k in enumerate(group):
                out[k] = "\n".join(b.text for b, good in zip(pages[k], y[:, j].tolist(), strict=False) if good)
        return out


@cache
def train(pages: int = 900, steps: int = 420, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Labeller:
    """Fit on made-up pages by backpropagation through time; the same result on every call."""
    rng = np.random.default_rng(seed)
    memo: dict = {}
    data = []
    while len(data) < pages:
        html, main = make_page(rng)
        blocks = read_blocks(html)
        if blocks:
            data.append((*slots(blocks, memo), figures(blocks), np.array([b.text in main for b in blocks], F4)))
    d = 2 * DIM + FIGURES
    net = Labeller(np.zeros((PATH_SLOTS, DIM), F4), np.zeros((WORD_SLOTS, DIM), F4), [rng.normal(0, 0.2, (4 * HIDDEN, d + HIDDEN + 1)).astype(F4) for _ in range(2)], rng.normal(0, 0.2, 2 * HIDDEN + 1).astype(F4))
    for g in net.gates:
        g[HIDDEN : 2 * HIDDEN, -1] = 1
    for table_, part in ((net.path, 0), (net.word, 2)):  # only what occurs in training gets a vector
        seen = np.unique(np.concatenate([x[part] for x in data]))
        table_[seen] = rng.normal(0, 0.3, (len(seen), DIM))
    params = [net.path, net.word, *net.gates, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        grads = _gradients(net, [data[i] for i in rng.integers(len(data), size=batch)], rng)
        lr = F4(rate * min(1.0, 2 * (1 - step / (steps + 1))))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += F4(0.1) * (g - a)
            b += F4(0.01) * (g * g - b)
            p -= lr * (a / F4(1 - 0.9**step)) / (np.sqrt(b / F4(1 - 0.99**step)) + F4(1e-7))
    return net


def _gradients(net: Labeller, rows: list[tuple], rng: np.random.Generator) -> list[np.ndarray]:
    size, n, d = max(len(r[5]) for r in rows), len(rows), 2 * DIM + FIGURES
    x, live, y = np.zeros((size, n, d), F4), np.zeros((size, n), F4), np.zeros((size, n), F4)
    kept = []
    for j, (p, pw, w, ww, fig, label) in enumerate(rows):
        k = len(label)
        a, b = rng.random(len(p)) > 0.1, rng.random(len(w)) > 0.3  # names and words are dropped at random
        p, pw, w, ww = p[a], pw[a], w[b], ww[b]
        x[:k, j] = np.hstack([_mean(net.path, p, pw, k), _mean(net.word, w, ww, k), fig])
        live[:k, j], y[:k, j] = 1, label
        kept.append((p, pw, w, ww))
    trace: dict = {}
    z = net.forward(x, live, trace)
    g_z = ((1 / (1 + np.exp(-z)) - y) * live / live.sum()).astype(F4)
    s = trace["s"]
    g_out = np.r_[np.einsum("tn,tnh->h", g_z, s), g_z.sum()].astype(F4)
    g_s = g_z[..., None] * net.out[:-1]
    g_x, g_gates = np.zeros_like(x), []
    for k, g in enumerate(net.gates):
        g_a_all = np.zeros((size, n, 4 * HIDDEN), F4)
        g_h, g_c = np.zeros((n, HIDDEN), F4), np.zeros((n, HIDDEN), F4)
        own, g_own = g[:, d:-1], np.zeros((4 * HIDDEN, HIDDEN), F4)
        for t in range(size - 1, -1, -1) if k == 0 else range(size):
            h, c, i, f, o, u, tc = trace[k, t]
            on = live[t, :, None]
            up = (g_h + g_s[t, :, k * HIDDEN : (k + 1) * HIDDEN]) * on
            g_new = (g_c + up * o * (1 - tc * tc)) * on
            g_a = np.hstack([g_new * u * i * (1 - i), g_new * c * f * (1 - f), up * tc * o * (1 - o), g_new * i * (1 - u * u)])
            g_a_all[t] = g_a
            g_own += g_a.T @ h
            g_h, g_c = g_a @ own, g_new * f
        flat = g_a_all.reshape(-1, 4 * HIDDEN)
        g_gates.append(np.hstack([flat.T @ x.reshape(-1, d), g_own, flat.sum(0)[:, None]]))
        g_x += g_a_all @ g[:, :d]
    g_path, g_word = np.zeros_like(net.path), np.zeros_like(net.word)
    for j, (p, pw, w, ww) in enumerate(kept):
        for out, k, of, lo in ((g_path, p, pw, 0), (g_word, w, ww, DIM)):
            if len(k):
                np.add.at(out, k, g_x[of, j, lo : lo + DIM] / np.bincount(of)[of][:, None])
    return [g_path, g_word, *g_gates, g_out]


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        memo: dict = {}
        for batch in slices(batches, 512):
            blocks = [read_blocks(x.as_py(), names) for x in batch.column(2)]
            texts = net.main_text(blocks, memo)
            n = [pa.array(list(map(len, x)), pa.int64()) for x in (texts, blocks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *n], ["page_id", "url", "text", "n_chars", "n_blocks"])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long, n_blocks long")


def op3_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train())
