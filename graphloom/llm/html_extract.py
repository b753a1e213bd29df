"""Main-text extraction: a bidirectional LSTM in numpy labels the leaf blocks of a page.

A page is read into a sequence of leaf blocks (text between block-level tags; inline markup doesn't split a block, scripts, styles and comments
hold no text). Each block is a vector: its tag path with classes and ids, hashed; all its words, hashed; and its length, link share and place. Two LSTMs
read the whole sequence forwards and backwards, so that each block is labelled in the context of the document; a logistic layer gives the probability of
main text. The text is the blocks over 0.5, in page order, joined by a line end.

The network is trained on the driver, by Adam on pages that a seeded generator writes with known labels (layouts, tag names, classes and languages vary); its
size is fixed (about 40,000 numbers), so it is broadcast. Training takes a few seconds and is kept for the process.

Defined results: null or empty html gives empty text; what scripts, styles, text areas, templates, frames, drawings and noscript elements hold is no text of the page; broken markup is read as far as it goes (unclosed tags end with their parent, an unclosed raw element ends
with the page; a quote without its pair is an ordinary character of its tag); a page of many blocks is read in pieces of PIECE blocks that pass their state on; repeated rows give equal texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import quoted, short_batches, slices, utf8, word_hashes

PATH_BITS, WORD_BITS, EXTRA, HIDDEN = 96, 48, 6, 24
INPUT = PATH_BITS + WORD_BITS + EXTRA
#: Blocks that the network reads at once.
PIECE = 4096
#: A tag's attributes end at the first > outside of quotes; where quotes don't pair, at the first >.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>)", re.S)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed values of the HTML standard: elements without content, elements whose content is no markup, and inline elements.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = set("script style textarea noscript template iframe svg".split())
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that an opening block-level tag closes.
_CLOSED_BY_BLOCK = {"p"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Open(NamedTuple):
    """An open element: its tag, the slots of all words of its path as one number, and the last of them."""

    tag: str
    slots: int
    last: str


@lru_cache(1 << 14)
def _slot(word: str) -> int:
    return 1 << xxhash.xxh3_64_intdigest(word) % PATH_BITS


def _opened(tag: str, name: str, within: _Open) -> _Open:
    slots, last = within.slots, within.last
    for word in re.split(r"[^a-z0-9]+", f"{tag} {name}"):
        if word:
            slots, last = slots | _slot(word), word
    return _Open(tag, slots, last)


def blocks(page: str) -> list[tuple[int, str, float]]:
    """(slots of the path, text, share of its characters in links) of each leaf block. An open element holds what its block needs, so work grows with the page's length, however
    deep it nests."""
    out: list[tuple[int, str, float]] = []
    stack = [_Open("", 0, "")]
    open_: Counter[str] = Counter()
    held: list[str] = []
    links = 0
    in_link = 0
    at = 0
    # no tag begins where no > follows
    limit = page.rfind(">") + 1

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            top = stack[-1]
            out.append((top.slots | (_slot(f"/{top.last}") if top.last else 0), text, min(1.0, links / max(1, len(text)))))
        held.clear()
        links = 0

    def close() -> str:
        tag = stack.pop().tag
        open_[tag] -= 1
        return tag

    for m in iter(lambda: _TAG.search(page, at, limit), None):
        text = page[at : m.start()]
        if text:
            held.append(text)
            links += len(text) * (in_link > 0)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                in_link = 0 if m[1] else 1
            continue
        flush()
        if m[1]:
            if open_[tag] > 0:
                while close() != tag:
                    pass
                in_link = 0
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            continue
        while stack[-1].tag in _CLOSED_BY_BLOCK or stack[-1].tag in _SAME.get(tag, ()):
            close()
        attributes = m[3] if m[3] is not None else m[4]
        name = " ".join(x or y or z for x, y, z in _ATTR.findall(attributes)).lower() if attributes else ""
        if not attributes.rstrip().endswith("/"):
            stack.append(_opened(tag, name, stack[-1]))
            open_[tag] += 1
    rest = page[at:].partition("<!--")[0]
    if rest:
        held.append(rest)
    flush()
    return out


def vectors(found: list[tuple[int, str, float]], first: int = 0, total: int | None = None) -> np.ndarray:
    """Of blocks `first` and on of a page that has `total`. All words of a block count."""
    x = np.zeros((len(found), INPUT), np.float32)
    hashes, words = word_hashes([text.encode("utf-8", "surrogatepass") for _, text, _ in found])
    at = np.repeat(np.arange(len(found)), words) * WORD_BITS + (hashes % np.uint64(WORD_BITS)).astype(np.int64)
    x[:, PATH_BITS : PATH_BITS + WORD_BITS] = np.bincount(at, minlength=len(found) * WORD_BITS).reshape(-1, WORD_BITS) / np.maximum(words, 1)[:, None]
    paths = np.frombuffer(b"".join(slots.to_bytes(PATH_BITS // 8, "little") for slots, _, _ in found), np.uint8).reshape(-1, PATH_BITS // 8)
    x[:, :PATH_BITS] = np.unpackbits(paths, axis=1, bitorder="little")
    for i, (_, text, share) in enumerate(found):
        x[i, -EXTRA:] = (min(1.0, np.log1p(len(text)) / 8), share, min(1.0, words[i] / 40), float(text[-1] in ".!?;:"), (first + i) / (total or len(found)), 1.0)
    return x


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(w: np.ndarray, u: np.ndarray, b: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool, state: list | None = None) -> tuple[np.ndarray, list]:
    """An LSTM over x (time, batch, input); padded places leave the state as it is. state: where it starts, and then where it ended."""
    t, n, _ = x.shape
    h, c = state or [np.zeros((n, HIDDEN), np.float32)] * 2
    out, steps = np.zeros((t, n, HIDDEN), np.float32), []
    pre = x @ w + b
    for i in range(t):
        z = pre[i] + h @ u
        gi, gf, go = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        gc = np.tanh(z[:, 3 * HIDDEN :])
        c2 = gf * c + gi * gc
        th = np.tanh(c2)
        h2 = go * th
        m = mask[i][:, None]
        if keep:
            steps.append((h, c, gi, gf, go, gc, th, m))
        h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
        out[i] = h
    if state is not None:
        state[:] = h, c
    return out, steps


def _back(w: np.ndarray, u: np.ndarray, x: np.ndarray, steps: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, n, _ = x.shape
    dz = np.zeros((t, n, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh = dc = np.zeros((n, HIDDEN), np.float32)
    for i in range(t - 1, -1, -1):
        h, c, gi, gf, go, gc, th, m = steps[i]
        dh = dh + d_out[i]
        step_h, step_c = dh * m, dc * m
        d_c2 = step_c + step_h * go * (1 - th**2)
        z = dz[i]
        z[:, :HIDDEN] = d_c2 * gc * gi * (1 - gi)
        z[:, HIDDEN : 2 * HIDDEN] = d_c2 * c * gf * (1 - gf)
        z[:, 2 * HIDDEN : 3 * HIDDEN] = step_h * th * go * (1 - go)
        z[:, 3 * HIDDEN :] = d_c2 * gi * (1 - gc**2)
        du += h.T @ z
        dh = z @ u.T + dh * (1 - m)
        dc = d_c2 * gf + dc * (1 - m)
    return x.reshape(t * n, -1).T @ dz.reshape(t * n, -1), du, dz.sum((0, 1))


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in xs)
    out, mask = np.zeros((t, len(xs), INPUT), np.float32), np.zeros((t, len(xs)), np.float32)
    for i, x in enumerate(xs):
        out[: len(x), i], mask[: len(x), i] = x, 1
    return out, mask


def probabilities(model: dict[str, np.ndarray], xs: list[np.ndarray], keep: bool = False):
    """Of main text, for each block of each page."""
    x, mask = _padded(xs)
    a, sa = _run(model["wf"], model["uf"], model["bf"], x, mask, keep)
    b, sb = _run(model["wb"], model["ub"], model["bb"], x[::-1], mask[::-1], keep)
    both = np.concatenate((a, b[::-1]), 2)
    p = _sigmoid(both @ model["v"] + model["c"])
    return (p, x, mask, both, sa, sb) if keep else [p[: len(q), i] for i, q in enumerate(xs)]


def page_probabilities(model: dict[str, np.ndarray], found: list[tuple[int, str, float]], piece: int = PIECE) -> np.ndarray:
    """probabilities() of one page of any number of blocks: the pieces are read in order, and from the last one back; only states are kept."""
    n, out = len(found), []
    starts = range(0, n, piece)
    for d, pieces in (("f", starts), ("b", reversed(starts))):
        state, parts = [], []
        for at in pieces:
            x = vectors(found[at : at + piece], at, n)[:, None, :]
            h, _ = _run(model[f"w{d}"], model[f"u{d}"], model[f"b{d}"], x if d == "f" else x[::-1], np.ones((len(x), 1), np.float32), False, state)
            parts.append(h[:, 0] if d == "f" else h[::-1, 0])
        out.append(np.concatenate(parts if d == "f" else parts[::-1]))
    return _sigmoid(np.concatenate(out, 1) @ model["v"] + model["c"])


# ---------------------------------------------------------------- training pages

_SYLLABLES = "the and ion ent ter ing tha ere re on an ou ai en que le tion de la ment eau pas sch ein ung heit lich ber der ver os la ci ar do es que mente".split()
_SIDE_WORDS = "home about contact login search menu subscribe share follow copyright rights reserved privacy terms cookie cookies accept reply comments comment related popular tags archive sponsored advertisement next previous".split()


def _prose(r: random.Random, words: int) -> str:
    junk = r.choice(["", "", "", "%%%", "!!"])
    text = " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) + junk for _ in range(words))
    if r.random() < 0.1:
        text = text.upper()
    return text[:1].upper() + text[1:] + r.choice([".", ".", ".", "", "!"])


def training_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and the label of each of its blocks (in the order blocks() gives them)."""
    out: list[str] = []
    labels: list[bool] = []

    def block(text: str, main: bool, before: str = "<p>", after: str = "</p>") -> None:
        out.append(before + text + after)
        labels.append(main)

    def side(n: int) -> str:
        pick = r.random()
        if pick < 0.5:
            return " ".join(r.choice(_SIDE_WORDS) for _ in range(n)).title()
        return _prose(r, n) if pick < 0.8 else " ".join(r.choice(_SYLLABLES) for _ in range(n))

    def menu(tag: str, name: str) -> None:
        out.append(f"<{tag}{name}><ul>")
        for _ in range(r.randint(2, 9)):
            block(f'<a href="/{r.choice(_SYLLABLES)}">{side(r.randint(1, 3))}</a>', False, "<li>", "</li>")
        out.append(f"</ul></{tag}>")

    def box(names: list[str], lo: int, hi: int, plain: bool = True, tags: tuple[str, ...] = ("div", "section", "div")) -> None:
        tag = r.choice(tags)
        name = r.choice(names)
        out.append(f'<{tag} {r.choice(["class", "id"])}="{name}">')
        for _ in range(r.randint(1, 3)):
            block(side(r.randint(lo, hi)), False, *r.choice([("<p>", "</p>"), ("<h3>", "</h3>"), ("<div>", "</div>")]))
        out.append(f"</{tag}>")

    if r.random() < 0.06:  # a fragment: blocks without any tag are text
        block(_prose(r, r.choice([1, 3, 12, 60])), True, "", "")
        if r.random() < 0.6:
            menu(*r.choice([("nav", ""), ("div", ' class="menu"')]))
            block(_prose(r, r.randint(3, 30)), True, "", "")
        return "".join(out), labels
    title = _prose(r, r.randint(2, 9))
    out.append("<!DOCTYPE html><html><head><meta charset='utf-8'>")
    block(title, False, "<title>", "</title>")
    out.append("<style>p{}</style><script>var x='</p>';</script></head><body>")
    ads, notices = ["ad", "ads", "advert", "sponsored", "promo banner"], ["cookie-notice", "notice", "cookie", "newsletter", "popup", "alert"]
    if r.random() < 0.5:
        block(side(r.randint(1, 5)), False, *r.choice([("<header><h2>", "</h2></header>"), ('<div class="header"><p>', "</p></div>"), ("<header><p>", "</p></header>")]))
    if r.random() < 0.85:
        menu(*r.choice([("nav", ""), ("nav", ""), ("nav", ' class="menu"'), ("div", ' class="nav"'), ("div", ' id="menu"'), ("header", "")]))
    if r.random() < 0.6:
        out.append(f'<!-- ad --><div class="{r.choice(ads)}">')
        block(side(r.randint(2, 14)), False, "", "")
        out.append("</div>")
    if r.random() < 0.25:
        box(notices, 3, 20)
    if r.random() < 0.25:
        box(["sidebar", "aside", "widget"], 2, 12, tags=("aside", "div", "aside"))
    open_, close = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article">', "</div>"), ('<div class="post entry">', "</div>"), ('<section class="article-body">', "</section>")])
    out.append(open_)
    if r.random() < 0.9:
        block(title if r.random() < 0.7 else _prose(r, 5), True, "<h1>", "</h1>")
    for i in range(r.choice([1, 2, 3, 5, 8, 14])):
        pick = r.random()
        if pick < 0.15:
            block(f"<b>{_prose(r, r.randint(1, 12))}<br>", True, "<p>", "")
        elif pick < 0.22:
            block(_prose(r, r.randint(1, 4)), True, "<h2>", "</h2>")
        elif pick < 0.3:
            out.append("<ul>")
            for _ in range(r.randint(1, 4)):
                block(_prose(r, r.randint(1, 9)), True, "<li>", "</li>")
            out.append("</ul>")
        elif pick < 0.34:
            block(_prose(r, r.randint(3, 25)), True, "<blockquote>", "</blockquote>")
        elif pick < 0.37:
            block(_prose(r, r.randint(1, 8)), True, "<table><tr><td>", "</td></tr></table>")
        elif pick < 0.41:
            block(f'{_prose(r, 6)} <a href="/x">{_prose(r, 2)}</a>', True)
        else:
            block(_prose(r, r.choice([1, 2, 4, 10, 25, 60])), True)
        if r.random() < 0.04:
            out.append(f'<div class="{r.choice(ads)}">')
            block(side(r.randint(2, 10)), False, "", "")
            out.append("</div>")
    out.append(close)
    if r.random() < 0.3:
        out.append(r.choice(['<div class="comments">', '<section id="comments">', '<div class="comment-list">']))
        for _ in range(r.randint(1, 5)):
            block(_prose(r, r.randint(2, 30)), False, *r.choice([("<p>", "</p>"), ('<div class="comment">', "</div>"), ("<li>", "</li>")]))
        out.append(r.choice(["</div>", "</section>"]) if False else "</div></section>")
    if r.random() < 0.2:
        out.append('<form action="/s">')
        block(side(r.randint(1, 4)), False, "<label>", "</label>")
        out.append("</form>")
    if r.random() < 0.2:
        box(["related", "sidebar", "share social", "widget"], 2, 10, tags=("aside", "div", "aside"))
    if r.random() < 0.9:
        block(f"&copy; {side(1)} &middot; {side(r.randint(2, 10))}", False, *r.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ("<footer><p>", "</p></footer>")]))
    if r.random() < 0.8:
        out.append("</body></html>")
    return "".join(out), labels


@cache
def trained(seed: int = 3, pages: int = 640, epochs: int = 14) -> dict[str, np.ndarray]:
    r, rng = random.Random(seed), np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = training_page(r)
        found = blocks(page)
        if len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = {f"{k}{d}": v for d in "fb" for k, v in (("w", scale(INPUT, 4 * HIDDEN)), ("u", scale(HIDDEN, 4 * HIDDEN)), ("b", np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)))}
    model |= {"v": scale(2 * HIDDEN, 1)[:, 0], "c": np.zeros((), np.float32)}
    mean, square, step = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2)), None, 0
    mean, square = tuple(mean)
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i : i + 32] for i in range(0, len(data), 32)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            xs, ys = [d[0] for d in groups[g]], [d[1] for d in groups[g]]
            p, x, mask, both, sa, sb = probabilities(model, xs, keep=True)
            y = np.zeros_like(mask)
            for i, v in enumerate(ys):
                y[: len(v), i] = v
            d = (p - y) * mask / mask.sum()
            d_both = d[:, :, None] * model["v"]
            grads = {"v": (both * d[:, :, None]).sum((0, 1)), "c": d.sum()}
            for k, xx, s, dd in (("f", x, sa, d_both[:, :, :HIDDEN]), ("b", x[::-1], sb, d_both[::-1, :, HIDDEN:])):
                grads |= dict(zip((f"w{k}", f"u{k}", f"b{k}"), _back(model[f"w{k}"], model[f"u{k}"], xx, s, dd), strict=True))
            step += 1
            rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
            for k, v in grads.items():
                v = np.clip(v, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                model[k] = (model[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def texts_of(model: dict[str, np.ndarray], pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)

    def put(i: int, p: np.ndarray) -> None:
        out[i] = "\n".join(b[1] for b, x in zip(found[i], p, strict=True) if x > 0.5)

    for i, f in enumerate(found):
        if len(f) > PIECE:
            put(i, page_probabilities(model, f))
    order = sorted((i for i, f in enumerate(found) if 0 < len(f) <= PIECE), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and len(some) < 64 and len(found[order[at + len(some)]]) * (len(some) + 1) <= 8000:
            some.append(order[at + len(some)])
        for i, p in zip(some, probabilities(model, [vectors(found[i]) for i in some]), strict=True):
            put(i, p)
        at += len(some)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars."""
    short_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())
    base = pages.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(url_col)).alias("url"), F.coalesce(F.col(quoted(html_col)), F.lit("")).alias("html"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "html"):
            texts = texts_of(sent.value, [x.decode("utf-8") for x in utf8(b.column("html"))])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return base.mapInArrow(run, "id long, url string, text string, n_chars long")
