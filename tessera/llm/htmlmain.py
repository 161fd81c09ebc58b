"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks (text between block-level tags).  A
block's vector holds its hashed tag path (tags, classes and ids of the ancestors), its
hashed words and a few measures (length, link share, punctuation, place).  A bidirectional
LSTM reads the whole sequence and labels every block as article text or not; the article
blocks are joined in page order.

The network is trained in numpy on pages that ``synthetic_page`` composes, with known
labels, from a fixed seed: a bounded set that does not depend on the data.

Defined results: null, empty or text-free html gives the empty text; unclosed and stray
tags are closed as browsers do; memory is linear in a page's text and time in its length;
scripts, styles, templates, comments and the head never
are text; repeated rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import slices

#: Elements whose content is no text, void elements, and elements that stand inside a block.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "title", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A start tag closes an open element of these kinds within its container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body", "td", "th", "aside", "nav", "header", "footer", "form", "blockquote"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")

PATHS, WORDS, MEASURES = 160, 48, 8
INPUT = PATHS + WORDS + MEASURES
HIDDEN = 20
PAGES, EPOCHS, BATCH, RATE, SEED = 700, 16, 64, 0.015, 23
#: Elements kept of either end of a tag path, names of an element, padded blocks of a batch, and blocks of a long page read at once.
DEPTH, NAMES, ROOM, SPAN = 16, 16, 8192, 4096


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page, with the names on their tag path."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    path: tuple[str, ...] = ()
    linked, links, at, n, spoken = 0, 0, 0, len(page), False

    def flush() -> None:
        nonlocal pieces, linked, spoken
        spoken = False
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(path, text, linked))
            pieces, linked = [], 0

    def say(raw: str) -> None:
        nonlocal path, linked, spoken
        text = entities.unescape(raw) if "&" in raw else raw
        if text:
            starts = not spoken and bool(text.strip())
            if not pieces or starts:
                # The outermost and the innermost elements: a path is of bounded length however deep a page nests.
                near = stack if len(stack) <= 2 * DEPTH else stack[:DEPTH] + stack[-DEPTH:]
                path = tuple(name for _, names in near for name in names[:NAMES])
            spoken = spoken or starts
            pieces.append(text)
            if links:
                linked += len(text)

    def pop(to: int) -> None:
        nonlocal links
        links -= sum(tag == "a" for tag, _ in stack[to:])
        del stack[to:]

    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        hit = TOKEN.match(page, start) or LOOSE.match(page, start)
        if not hit:
            say("<")
            at = start + 1
            continue
        at = hit.end()
        tag = hit[2].lower() if hit.lastindex else None
        if tag is None:
            continue
        if hit[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
            shut = CLOSES.get(tag, ()) if tag in CLOSES else {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    pop(i)
                    break
                if stack[i][0] in HOLDS and stack[i][0] not in shut:
                    break
        if tag in VOID or hit[3].endswith("/") and tag in INLINE:
            continue
        names = [tag]
        if "=" in hit[3]:
            for kind, *value in ATTRIBUTE.findall(hit[3]):
                names += [f"{kind.lower()}:{x}" for x in NAME.findall("".join(value).lower())]
        stack.append((tag, tuple(names)))
        links += tag == "a"
    flush()
    return out


class _Buckets(dict):
    def __init__(self, size: int, kept: int = 200_000):
        super().__init__()
        self.size, self.kept = size, kept

    def __missing__(self, name: str) -> int:
        if len(self) > self.kept:
            self.clear()
        i = self[name] = zlib.crc32(name.encode()) % self.size
        return i


_path_buckets, _word_buckets = _Buckets(PATHS), _Buckets(WORDS)


def features(page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """Vectors of the blocks from ``start`` to ``stop``."""
    n = len(page)
    some = page[start:stop]
    out = np.zeros((len(some), INPUT), np.float32)
    for i, b in enumerate(some, start):
        row = out[i - start]
        for depth, name in enumerate(reversed(b.path)):
            k = _path_buckets[name]
            row[k] = max(row[k], 1.0 if depth < 3 else 0.7)
        words = b.text.lower().split(" ")
        found = np.bincount(np.fromiter(map(_word_buckets.__getitem__, words), np.int64, len(words)), minlength=WORDS)
        row[PATHS : PATHS + WORDS] = found / len(words)
        size = len(b.text)
        row[PATHS + WORDS :] = (
            min(np.log1p(size) / 8, 1.5), min(np.log1p(len(words)) / 6, 1.5), min(b.linked / size, 1.0), b.text[-1] in ".!?:;\"”»",
            min(10 * sum(map(b.text.count, ",.;")) / size, 1.5), i / n, min(n / 100, 1.0), size / len(words) > 25,
        )
    return out


# ---- the network -------------------------------------------------------------


def _start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.15, (INPUT, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["o"], w["oc"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(w: dict, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """One direction over (time, page, input); where the mask is 0 the state stays as it is."""
    steps, pages = mask.shape
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
    drive = x @ w[f"x{d}"] + w[f"c{d}"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = drive[t] + h @ w[f"h{d}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        m = mask[t][:, None]
        kept.append((t, h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, kept


def _logits(w: dict, x: np.ndarray, mask: np.ndarray):
    hf, kf = _pass(w, "f", x, mask)
    hb, kb = _pass(w, "b", x, mask)
    both = np.concatenate([hf, hb], axis=2)
    return both @ w["o"] + w["oc"], both, (kf, kb)


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the blocks, and its gradients."""
    z, both, kept = _logits(w, x, mask)
    p = _sigmoid(z)
    n = mask.sum()
    loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n
    dz = mask * (p - y) / n
    grad = {"o": (dz[..., None] * both).sum(axis=(0, 1)), "oc": np.array([dz.sum()])}
    dboth = dz[..., None] * w["o"]
    for d, steps, part in (("f", kept[0], slice(0, HIDDEN)), ("b", kept[1], slice(HIDDEN, None))):
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc, dx_all, gh = np.zeros_like(dh), np.zeros((*mask.shape, 4 * HIDDEN), np.float32), np.zeros_like(w[f"h{d}"])
        for t, h, c, i, f, o, g, tc, m in reversed(steps):
            dh = dh + dboth[t][:, part]
            own = m * dh
            dcell = m * dc + own * o * (1 - tc * tc)
            dz4 = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), own * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
            dx_all[t] = dz4
            gh += h.T @ dz4
            dh = (1 - m) * dh + dz4 @ w[f"h{d}"].T
            dc = (1 - m) * dc + dcell * f
        flat = dx_all.reshape(-1, 4 * HIDDEN)
        grad[f"x{d}"], grad[f"h{d}"], grad[f"c{d}"] = x.reshape(-1, INPUT).T @ flat, gh, flat.sum(axis=0)
    return float(loss), grad


def _padded(pages: list[np.ndarray], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    steps = steps or max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


@functools.cache
def network() -> dict[str, np.ndarray]:
    """Weights after Adam on PAGES composed pages."""
    rng = random.Random(SEED)
    data = []
    while len(data) < PAGES:
        page, labels = synthetic_page(rng)
        found = blocks(page)
        if found:
            data.append((features(found), np.array([b.text in labels for b in found], np.float32)))
    w = _start()
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        # Pages of like length run together, in another order each time.
        data.sort(key=lambda s: len(s[0]) * rng.uniform(0.8, 1.25))
        starts = [*range(0, len(data), BATCH)]
        rng.shuffle(starts)
        for a in starts:
            some = data[a : a + BATCH]
            x, mask = _padded([s[0] for s in some])
            y = np.zeros(mask.shape, np.float32)
            for k, s in enumerate(some):
                y[: len(s[1]), k] = s[1]
            _, grad = gradients(w, x, mask, y)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - RATE * (0.5 if epoch > EPOCHS // 2 else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def _forward(w: dict, d: str, x: np.ndarray, mask: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_pass``, from a given state and without what only training needs; returns the states out, h and c."""
    steps = len(mask)
    out = np.empty((steps, *h.shape), np.float32)
    drive = x @ w[f"x{d}"] + w[f"c{d}"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = drive[t] + h @ w[f"h{d}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        c2 = f * c + i * np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        h, c = m * (o * np.tanh(c2)) + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, h, c


def _scores(w: dict, pages: list[list[Block]]) -> np.ndarray:
    """Logits (block, page), in spans of SPAN blocks: the backward states of a span's beginning are kept, not its vectors."""
    steps, n = max(map(len, pages)), len(pages)
    zero = np.zeros((n, HIDDEN), np.float32)
    z = np.full((steps, n), w["oc"][0], np.float32)

    def read(a: int) -> tuple[np.ndarray, np.ndarray]:
        return _padded([features(p, a, min(a + SPAN, len(p))) for p in pages], min(SPAN, steps - a))

    h, c = zero, zero
    for a in range(0, steps, SPAN):
        out, h, c = _forward(w, "f", *read(a), h, c)
        z[a : a + SPAN] += out @ w["o"][:HIDDEN]
    h, c = zero, zero
    for a in reversed(range(0, steps, SPAN)):
        out, h, c = _forward(w, "b", *read(a), h, c)
        z[a : a + SPAN] += out @ w["o"][HIDDEN:]
    return z


def label(w: dict, pages: list[list[Block]]) -> list[list[bool]]:
    """Whether each block is article text; pages of like length run together, ROOM padded blocks or one page at a time."""
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    out: list[list[bool]] = [[] for _ in pages]
    while order:
        some: list[int] = []
        while order and len(some) < BATCH and (not some or len(pages[order[0]]) * (len(some) + 1) <= ROOM):
            some.append(order.pop(0))
        z = _scores(w, [pages[k] for k in some])
        for j, k in enumerate(some):
            out[k] = (z[: len(pages[k]), j] > 0).tolist()
    return out


def main_text(w: dict, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, y in zip(bs, ys, strict=True) if y) for bs, ys in zip(found, label(w, found), strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    w = network()
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = main_text(w, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


# ---- pages with known labels --------------------------------------------------


def synthetic_page(rng: random.Random) -> tuple[str, set[str]]:
    """A composed page, and the texts of its article blocks."""
    syllables = ["".join(rng.choices("aeiouéübcdfghklmnprstvz", k=rng.randint(1, 4))) for _ in range(rng.randint(12, 60))]
    used: set[str] = set()
    article: set[str] = set()

    def words(low: int, high: int, stop: str = ".") -> str:
        while True:
            text = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) + ("," if rng.random() < 0.06 else "") for _ in range(rng.randint(low, high))).rstrip(",")
            text = text.capitalize() + stop
            if text not in used:
                used.add(text)
                return text

    def prose() -> str:
        return words(1, 4) if rng.random() < 0.15 else " ".join(words(2, 18) for _ in range(rng.randint(1, 7)))

    def body(text: str) -> str:
        article.add(text)
        return text

    def inline(text: str) -> str:
        if rng.random() < 0.2 and " " in text:
            a, _, b = text.partition(" ")
            tag = rng.choice(['a href="/x"', "b", "em", "span", "strong"])
            return f"<{tag}>{a}</{tag.split()[0]}> {b}"
        return text

    def named(tag: str, *names: str) -> str:
        if not names or rng.random() < 0.15:
            return f"<{tag}>"
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice(names)}">'

    def links(n: int) -> str:
        items = [f'<a href="/{k}">{words(1, 2, "")}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.75 else rng.choice([" | ", " ", "</span><span>"]).join(items)

    def menu() -> str:
        tag, names = rng.choice([("nav", ()), ("nav", ("menu", "navbar", "main-nav")), ("div", ("menu", "nav", "navigation", "breadcrumb", "topnav")), ("ul", ("menu", "nav-list"))])
        return (f"<{tag}>" if not names else f'<{tag} class="{rng.choice(names)}">') + links(rng.randint(2, 12)) + f"</{tag}>"

    def header() -> str:
        inner = rng.choice([f"<a href='/'>{words(1, 3, '')}</a>", f"<div class='logo'>{words(1, 3, '')}</div><p>{words(3, 8)}</p>", f"<h1>{words(1, 3, '')}</h1>" + menu(), f"<p>{words(3, 9)}</p>"])
        return f"<header>{inner}</header>" if rng.random() < 0.6 else f'<div class="{rng.choice(["header", "masthead", "site-header", "topbar"])}">{inner}</div>'

    def advert() -> str:
        name = rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"])
        return f'<!-- ad {rng.randint(0, 9)} --><div {rng.choice(["class", "class", "id"])}="{name}">{rng.choice(["", "Advertisement "])}{prose()}</div>'

    def notice() -> str:
        name = rng.choice(["notice", "cookie", "cookie-notice", "consent", "alert", "gdpr", "newsletter", "subscribe", "popup", "paywall"])
        return f'<div {rng.choice(["class", "id"])}="{name}"><p>{rng.choice(["We use cookies. ", "", ""])}{prose()}</p>{rng.choice(["<button>Accept</button>", "", "<a href=/p>" + words(1, 3, "") + "</a>"])}</div>'

    def side() -> str:
        inner = rng.choice([f"<h3>{words(1, 4, '')}</h3>" + links(rng.randint(2, 7)), "".join(f"<p>{prose()}</p>" for _ in range(rng.randint(1, 3))), f"<h2>{words(1, 4, '')}</h2><p>{prose()}</p>"])
        return f"<aside>{inner}</aside>" if rng.random() < 0.55 else f'<div class="{rng.choice(["sidebar", "side", "related", "widget", "share", "social", "recommended", "teaser"])}">{inner}</div>'

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 5, "")}</label><input name="q"><p>{prose()}</p><select><option>{words(1, 2, "")}<option>{words(1, 2, "")}</select><button>{words(1, 2, "")}</button></form>'

    def comments() -> str:
        each = "".join(f'<{t} class="comment"><p class="author">{words(1, 2, "")}</p><p>{prose()}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 5)))
        return f'<{rng.choice(["section", "div"])} {rng.choice(["id", "class"])}="{rng.choice(["comments", "replies", "discussion", "responses"])}"><h3>{words(1, 3, "")}</h3>{each}</div>'

    def footer() -> str:
        inner = rng.choice([f"&copy; {words(1, 3, '')} &middot; {prose()}", f"<p>{prose()}</p>", links(rng.randint(2, 6)), f"<p>{words(2, 9)}</p>" + links(3)])
        return f"<footer>{inner}</footer>" if rng.random() < 0.65 else f'<div {rng.choice(["class", "id"])}="{rng.choice(["footer", "site-footer", "copyright", "legal", "bottom"])}">{inner}</div>'

    def text_block() -> str:
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{inline(body(prose()))}" + ("</p>" if rng.random() < 0.85 else "")
        if kind < 0.72:
            return f"<p><b>{body(prose())}<br>"
        if kind < 0.8:
            level = rng.choice(["h2", "h2", "h3", "h4"])
            return f"<{level}>{body(words(1, 7, ''))}</{level}>"
        if kind < 0.88:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{inline(body(words(1, 15, rng.choice(['', '.']))))}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(2, 5))) + f"</{tag}>"
        if kind < 0.92:
            return f"<blockquote>{body(prose())}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{body(prose())}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{body(words(1, 3, ''))}</td><td>{body(words(1, 3, ''))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f"<pre>{body(words(3, 12))}</pre>"
        return f"<div>{body(prose())}</div>"

    def main() -> str:
        n = rng.choice([0, 1, 1, 2, 3, 5, 8, 12, 16])
        inner = [f"<h1>{body(words(1, 12, rng.choice(['', '.'])))}</h1>"] if rng.random() < 0.85 or not n else []
        if rng.random() < 0.25:
            inner.append(f"<p>{body(words(2, 6))}</p>")
        inner += [text_block() for _ in range(n)]
        for extra, chance in ((advert, 0.15), (side, 0.08), (notice, 0.06), (form, 0.04)):
            if rng.random() < chance and inner:
                inner.insert(rng.randint(1, len(inner)), extra())
        tag, names = rng.choice([("article", ()), ("article", ()), ("article", ("post", "story", "entry")), ("main", ()), ("div", ("content", "post", "article", "article-body", "entry-content", "story", "main")), ("section", ("content", "story"))])
        open_tag = f"<{tag}>" if not names else f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">'
        out = open_tag + "".join(inner) + f"</{tag}>"
        return f"<main>{out}</main>" if tag != "main" and rng.random() < 0.25 else out

    if rng.random() < 0.3:
        parts = [menu(), advert(), main(), footer()]
    else:
        parts = [f() for f, chance in ((header, 0.5), (menu, 0.75), (advert, 0.35), (notice, 0.3), (side, 0.2), (form, 0.15)) if rng.random() < chance]
        if rng.random() < 0.3:
            rng.shuffle(parts)
        parts.append(main())
        parts += [f() for f, chance in ((side, 0.35), (comments, 0.35), (advert, 0.25), (form, 0.15), (notice, 0.15), (footer, 0.85)) if rng.random() < chance]
    if rng.random() < 0.15:
        parts = ['<div class="wrapper">', *parts, "</div>"]
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(2, 8, "")}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    glue = rng.choice(["", "\n", "\n  "])
    return head + glue.join(parts) + ("</body></html>" if rng.random() < 0.9 else ""), article
