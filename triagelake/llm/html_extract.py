"""Main-text extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with the tag path above it.  A bidirectional LSTM in numpy
reads, for each block, a tag-path vector, a hashed-word vector and a few shape figures, and labels every block
as main text or not with the whole page as context.  Blocks labelled main text are joined in page order.

The labeller is trained here, on generated pages whose blocks are labelled by construction (article text against
menus, headers, footers, sidebars, notices, adverts, forms and reader comments), never on the pages it reads.  Half of
these pages have an article element or a name that tells; the others have divisions with names that tell nothing,
sections, lines between breaks or a bare body, so that the labeller must go by the text and what stands around it.

A page costs time and memory in proportion to its length, however deep its elements lie and however many blocks it has.

Edge cases: null and empty html give an empty text; tags cut off at the end of a page are markup; unclosed tags
are closed by what surrounds them; every block is labelled, however many there are; repeated rows each come out;
further columns are carried, except those named text and n_chars; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import TO_LOWER, blocks, leading, range_hashes, table, word_bounds

#: Bytes of html labelled together.
PAGE_BYTES = 4 << 20

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|/?[a-zA-Z][^>]*(?:>|\Z))", re.DOTALL)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
# Fixed values of the markup language: elements without content, of raw text, and within a line.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg iframe".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


PATH_ROWS, WORD_ROWS, PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 512, 256, 16, 6, 6, 16


@lru_cache(1 << 16)
def _bucket(name: str) -> int:
    """The row of the path table for a name: the 64-bit FNV-1a hash."""
    h = 14695981039346656037
    for c in name.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h >> 20) % PATH_ROWS


class _Open:
    """An open element: the path rows of all elements down to it, and those with its own names again as the last one's.

    Rows are distinct places of a table of fixed size, so an element costs no more the deeper it lies, and one that
    brings no new row shares its parent's.
    """

    __slots__ = ("rows", "known", "last", "full")

    def __init__(self, rows: tuple[int, ...] = (), known: frozenset[int] = frozenset(), names: tuple[str, ...] = ("none",)):
        self.rows, self.known, self.full = rows, known, None
        self.last = tuple(dict.fromkeys(_bucket("last:" + x) for x in names))

    def child(self, names: tuple[str, ...]) -> _Open:
        new = tuple(r for r in dict.fromkeys(map(_bucket, names)) if r not in self.known)
        return _Open(self.rows + new, self.known | frozenset(new), names) if new else _Open(self.rows, self.known, names)

    def path(self) -> tuple[int, ...]:
        if self.full is None:
            self.full = self.rows + tuple(r for r in self.last if r not in self.known)
        return self.full


def leaves(page: str) -> list[tuple[tuple[int, ...], str, int]]:
    """(path rows, text, characters inside links) of the page's blocks, in page order; time and memory linear in the page."""
    out: list = []
    root = _Open()
    stack: list[tuple[str, _Open]] = []  # an inline element has its block's node
    depth: Counter[str] = Counter()
    buffer: list[str] = []
    path: tuple[int, ...] = ()
    linked = links = at = 0

    def flush():
        nonlocal buffer, linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((path, text, linked))
            buffer, linked = [], 0

    def pop() -> None:
        depth[stack.pop()[0]] -= 1

    def close(names) -> None:
        while stack and stack[-1][0] in names:
            pop()

    m = _TAG.search(page)
    while m:
        if m.start() > at:
            if not buffer:
                path = (stack[-1][1] if stack else root).path()
            buffer.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = (m.group(2) or "").lower()
        if tag and m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            if tag not in _INLINE:
                flush()
            if depth[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag:
            if tag in _RAW and not m.group().endswith("/>"):
                flush()
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            elif tag in _VOID:
                if tag in ("br", "hr"):
                    flush()
            else:
                if tag == "a":
                    links += 1
                if tag not in _INLINE:
                    flush()
                    while stack and stack[-1][0] in _INLINE:  # an open inline element ends with its block
                        pop()
                    links = 0
                    if tag in _P_ENDS:
                        close(("p",))
                    close(_CLOSES.get(tag, ()))
                node = stack[-1][1] if stack else root
                if tag not in _INLINE:
                    names = " ".join(x for g in _ATTR.findall(m.group(3) or "") for x in g if x).lower()
                    node = node.child((tag, *_NAME.findall(names)))
                stack.append((tag, node))
                depth[tag] += 1
        m = _TAG.search(page, at)
    if at < len(page):
        if not buffer:
            path = (stack[-1][1] if stack else root).path()
        buffer.append(page[at:])
    flush()
    return out


# ---- the labeller

def features(pages: list[list]) -> tuple[list, np.ndarray, list]:
    """Flat features of all blocks of some pages: path rows, shape figures, and (word rows, block) pairs."""
    texts = [t.encode("utf-8", "surrogatepass") for page in pages for _, t, _ in page]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    starts, ends, row = word_bounds(data, offs)
    h = range_hashes(TO_LOWER[data], starts, ends)
    size = np.diff(offs)
    flat = [b for page in pages for b in page]
    n_words = np.bincount(row, minlength=len(flat))
    place = np.concatenate([np.arange(len(b)) / max(1, len(b)) for b in pages]) if pages else np.zeros(0)
    linked = np.array([x for _, _, x in flat], float) / np.maximum(size, 1)
    stop = np.array([t[-1:] in (b".", b"!", b"?") for t in texts], float)
    shape = np.column_stack([np.log1p(size) / 8, np.log1p(n_words) / 6, np.minimum(linked, 1.0), stop, place, np.ones(len(flat))])
    return [p for p, _, _ in flat], shape, [(h >> np.uint64(13)) % np.uint64(WORD_ROWS), row]


class Labeller:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d, g = PATH_DIM + WORD_DIM + SHAPE_DIM, 4 * HIDDEN
        u = lambda *shape: (r.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)
        self.w = {"path": u(PATH_ROWS, PATH_DIM) * 8, "word": u(WORD_ROWS, WORD_DIM) * 2, "out": u(2 * HIDDEN + d, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.w |= {way + "x": u(d, g), way + "h": u(HIDDEN, g), way + "0": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)}

    def inputs(self, feats) -> np.ndarray:
        rows, shape, (word, of) = feats
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(count.sum()))
        path = np.add.reduceat(self.w["path"][flat], np.cumsum(count) - count, axis=0) / np.sqrt(count)[:, None] if len(rows) else np.zeros((0, PATH_DIM))
        n_words = np.maximum(np.bincount(of, minlength=len(rows)), 1)
        own = self.w["word"][word.astype(np.int64)]
        bag = np.stack([np.bincount(of, own[:, k], len(rows)) for k in range(WORD_DIM)], axis=1) / n_words[:, None]
        self._last = (flat, count, n_words)
        return np.concatenate([path, bag, shape], axis=1).astype(np.float32)

    def _lstm(self, x: np.ndarray, way: str, keep: bool):
        """x: time, batch, inputs. Hidden states and, if kept, what the backward pass needs."""
        t, b, _ = x.shape
        pre = x @ self.w[way + "x"] + self.w[way + "0"]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        out, kept = np.empty((t, b, HIDDEN), np.float32), []
        for k in range(t):
            z = pre[k] + h @ self.w[way + "h"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -20, 20)))
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                kept.append((f, i, o, g, c, th, h))
            h, c = o * th, new
            out[k] = h
        return out, kept

    def _lstm_back(self, x, way, kept, dh_all, grad):
        t, b, _ = x.shape
        dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        dz_all = np.empty((t, b, 4 * HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            f, i, o, g, c, th, h0 = kept[k]
            dh = dh + dh_all[k]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * c * f * (1 - f), dc * g * i * (1 - i), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad[way + "h"] += h0.T @ dz
            dz_all[k] = dz
            dh, dc = dz @ self.w[way + "h"].T, dc * f
        grad[way + "x"] += np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grad[way + "0"] += dz_all.sum(axis=(0, 1))
        return dz_all @ self.w[way + "x"].T

    def _grid(self, lens: np.ndarray):
        """Places of flat blocks in a time-by-page grid, forward, and reversed within each page."""
        page = np.repeat(np.arange(len(lens)), lens)
        time = np.arange(len(page)) - np.repeat(np.cumsum(lens) - lens, lens)
        return page, time, np.repeat(lens, lens) - 1 - time

    def run(self, x: np.ndarray, lens: np.ndarray, keep: bool = False):
        page, time, back = self._grid(lens)
        grid = np.zeros((2, int(lens.max()), len(lens), x.shape[1]), np.float32)
        grid[0, time, page], grid[1, back, page] = x, x
        hf, kf = self._lstm(grid[0], "f", keep)
        hb, kb = self._lstm(grid[1], "b", keep)
        joint = np.concatenate([hf[time, page], hb[back, page], x], axis=1)
        return joint @ self.w["out"] + self.w["bias"], (page, time, back, grid, hf, kf, hb, kb, joint)

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """For each page which of its blocks are main text. Pages run in groups of like length."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a) * len(pages[order[b]]) < 6000:
                b += 1
            group = [pages[k] for k in order[a:b]]
            lens = np.array([len(g) for g in group])
            z, _ = self.run(self.inputs(features(group)), lens)
            for k, part in zip(order[a:b], np.split(z > 0, np.cumsum(lens)[:-1])):
                out[k] = part
            a = b
        return out

    def fit(self, pages: list[list], labels: list[list[int]], epochs: int = 10, size: int = 16, rate: float = 0.01) -> None:
        r = random.Random(3)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        order = list(range(len(pages)))
        for _ in range(epochs):
            r.shuffle(order)
            for a in range(0, len(order), size):
                pick = order[a : a + size]
                group = [pages[k] for k in pick]
                y = np.concatenate([labels[k] for k in pick]).astype(np.float32)
                lens = np.array([len(g) for g in group])
                feats = features(group)
                x = self.inputs(feats)
                flat, count, n_words = self._last
                word, of = feats[2]
                z, (page, time, back, grid, hf, kf, hb, kb, joint) = self.run(x, lens, keep=True)
                dz = (1 / (1 + np.exp(-z)) - y) / len(y)
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                grad["out"], grad["bias"] = joint.T @ dz, dz.sum(keepdims=True)
                dj = dz[:, None] * self.w["out"]
                df, db = np.zeros_like(hf), np.zeros_like(hb)
                df[time, page], db[back, page] = dj[:, :HIDDEN], dj[:, HIDDEN : 2 * HIDDEN]
                gf, gb = self._lstm_back(grid[0], "f", kf, df, grad), self._lstm_back(grid[1], "b", kb, db, grad)
                dx = dj[:, 2 * HIDDEN :] + gf[time, page] + gb[back, page]
                each = np.repeat(dx[:, :PATH_DIM] / np.sqrt(count)[:, None], count, axis=0)
                grad["path"] = np.stack([np.bincount(flat, each[:, k], PATH_ROWS) for k in range(PATH_DIM)], axis=1).astype(np.float32)
                each = (dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / n_words[:, None])[of]
                grad["word"] = np.stack([np.bincount(word.astype(np.int64), each[:, k], WORD_ROWS) for k in range(WORD_DIM)], axis=1).astype(np.float32)
                step += 1
                for k, g in grad.items():
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.01 * (g * g - m2[k])
                    self.w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def training_page(r: random.Random) -> tuple[str, list[int]]:
    """A generated page and the labels of its blocks, in page order."""
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "ti", "re", "st", "ou", "le", "in", "de", "la", "que", "sch", "é", "ó")) for _ in range(r.randint(1, 4)))
    junk = r.choice(("", "", "", "", "***", "!!", " |"))
    words = lambda a, b: " ".join(word() + (junk if r.random() < 0.7 else "") for _ in range(r.randint(a, b)))
    line = lambda a, b: words(a, b).capitalize() + r.choice((".", ".", ".", "", "?"))
    out, y = [], []

    def block(text: str, label: int) -> str:
        y.append(label)
        return text

    def attr(names) -> str:
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'

    def menu() -> str:
        items = [f'<li><a href="/{k}">{block(words(1, 2), 0)}</a></li>' for k in range(r.randint(3, 9))]
        return r.choice((f"<nav><ul>{''.join(items)}</ul></nav>", f"<nav>{''.join(items)}</nav>", f"<div{attr(('menu', 'nav', 'navbar', 'main-menu', 'breadcrumb'))}><ul>{''.join(items)}</ul></div>"))

    def box(names, tags=("div", "section", "div"), a=3, b=25) -> str:
        t = r.choice(tags)
        inner = "".join(r.choice(("<p>{}</p>", "{}<br>")).format(block(line(a, b), 0)) for _ in range(r.randint(1, 3)))
        return f"<{t}{attr(names) if t in ('div', 'section') or r.random() < 0.4 else ''}>{inner}</{t}>"

    def lead() -> str:
        return r.choice(("<header>{}</header>", f"<div{attr(('header', 'site-header', 'masthead', 'banner'))}>{{}}</div>")).format(block(words(1, 5), 0))

    def advert() -> str:
        return f"<div{attr(('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-box'))}>{block(line(2, 16), 0)}</div>"

    def notice() -> str:
        return box(("cookie-notice", "notice", "consent", "popup", "newsletter", "subscribe"), a=4, b=20)

    def side() -> str:
        return box(("sidebar", "related", "widget", "share", "social"), ("aside", "aside", "div"), 2, 15)

    def form() -> str:
        return f'<form action="/s"><label>{block(words(1, 3), 0)}</label><input name="q"></form>'

    def comments() -> str:
        t = r.choice(("div", "section"))
        return f"<{t}{attr(('comments', 'comment-list', 'replies', 'comment'))}>" + "".join(r.choice(("<p>{}</p>", '<div class="comment">{}</div>')).format(block(line(3, 30), 0)) for _ in range(r.randint(1, 4))) + f"</{t}>"

    def named() -> str:
        """Attributes that say nothing of what is inside: columns, or a name of the page's own."""
        return r.choice(("", attr(("row", "col", "col-8", "col-md-9", "grid", "cell", "wrapper", "container", "inner", "box", "layout", "page")), attr((word() + word(), word() + "-" + word()))))

    def column() -> str:
        """A side column known by what it holds: a heading, then links or a few words each."""
        head = r.choice(("Related", "Popular", "Most read", "Latest", "More stories", "Archives", "Tags", "Share", "Follow us", "Topics", "See also", "Recent posts"))
        t = r.choice(("h2", "h3", "h3", "h4", "strong", "div"))
        out = [f"<{t}>{block(head, 0)}</{t}>"] if r.random() < 0.8 else []
        form = r.choice(('<li><a href="/{k}">{}</a></li>', '<p><a href="/{k}">{}</a></p>', '<a href="/{k}">{}</a><br>', "<li>{}</li>", '<div><a href="/{k}">{}</a></div>'))
        items = "".join(form.format(block(words(1, 6), 0), k=k) for k in range(r.randint(1, 7)))
        return "".join(out) + (f"<ul>{items}</ul>" if form.startswith("<li") else items)

    def prose() -> str:
        """An article without the elements made for one: under a section, plain divisions, line breaks or nothing at all."""
        body, n = [], r.choice((1, 2, 3, 4, 6, 10))
        if r.random() < 0.75:
            t = r.choice(("h1", "h1", "h2", "h3"))
            body.append(f"<{t}>{block(line(1, 10), 1)}</{t}>")
        form = r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "{}<br>", "{}<br><br>", "{}<br/>\n"))
        for _ in range(n):
            if r.random() < 0.1:
                body.append(f"<h3>{block(line(1, 6), 1)}</h3>")
            body.append(form.format(block(words(6, 60).capitalize() + r.choice((".", ".", ".", "")), 1)))
        inside = "".join(body)
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            t = r.choice(("div", "div", "section"))
            inside = f"<{t}{named()}>{inside}</{t}>"
        return r.choice((inside, inside, f'<section{attr(("news", "text", "main", "page", "story", "blog", "entry", word()))}>{inside}</section>'))

    def plain() -> str:
        """A page laid out by divisions with names that tell nothing."""
        cell = lambda inner: f"<div{named()}>{inner}</div>"
        parts = []
        if r.random() < 0.15:
            parts.append(cell(column()))
        parts.append(cell(prose()) if r.random() < 0.6 else prose())
        if r.random() < 0.5:
            parts.append(cell(column()))
        inside = "".join(parts)
        for _ in range(r.choice((0, 0, 1, 2))):
            inside = cell(inside)
        return inside

    def article() -> str:
        tag = r.choice(("article", "article", "article", "article", "main", "div"))
        a = attr(("content", "article", "post", "entry-content", "article-body", "story")) if tag == "div" or r.random() < 0.2 else ""
        body = []
        if r.random() < 0.85:
            body.append(f"<h1>{block(line(1, 14), 1)}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 25))):
            k = r.random()
            text = block(line(*r.choice(((1, 3), (3, 20), (15, 80)))), 1)
            if k < 0.7:
                body.append(r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p><b>{text}<br>")))
            elif k < 0.78:
                body.append(f"<h2>{text}</h2>")
            elif k < 0.86:
                body.append(f"<ul><li>{text}</li></ul>")
            elif k < 0.9:
                body.append(f"<blockquote>{text}</blockquote>")
            elif k < 0.94:
                body.append(f"<table><tr><td>{text}</td></tr></table>")
            else:
                body.append(f'<p>{text} <a href="/x">{words(1, 3)}</a></p>')
            if r.random() < 0.04:
                body.append(r.choice((advert, side, form))())
        return f"<{tag}{a}>{''.join(body)}</{tag}>"

    bare = r.random() < 0.5  # of the elements made for an article
    if bare and r.random() < 0.4:  # little else than the text
        start, end = r.choice((("", ""), ("<html><body>", "</body></html>"), ("<body>", "")))
        return start + plain() + end, y
    out.append("<!DOCTYPE html><html><head>")
    if r.random() < 0.9:
        out.append(f"<title>{block(words(1, 12), 0)}</title>")
    out.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    for part in (lead, menu, notice, advert):
        if r.random() < (0.8 if part is menu else 0.3 if part is not advert else 0.5):
            out.append(part())
    if r.random() < 0.15:
        out.append(side())
    out.append(plain() if bare else article())
    for part in (comments, side, advert, form, menu, notice):
        if r.random() < 0.2:
            out.append(part())
    if r.random() < 0.9:
        end = r.choice(("<footer>{}</footer>", "<footer><p>{}</p></footer>", f"<div{attr(('footer', 'site-footer', 'copyright'))}>{{}}</div>"))
        out.append(end.format(block(r.choice(("&copy; ", "", "&copy; " + word() + ".com &middot; ")) + line(2, 20), 0)))
    return "".join(out) + ("</body></html>" if r.random() < 0.9 else ""), y


@lru_cache(1)
def trained(pages: int = 900) -> Labeller:
    r = random.Random(11)
    made = []
    while len(made) < pages:
        page, y = training_page(r)
        found = leaves(page)
        if len(found) == len(y):
            made.append((found, y))
    model = Labeller()
    model.fit([b for b, _ in made], [y for _, y in made])
    return model


def main_text(model: Labeller, pages: list[str]) -> list[str]:
    found = [leaves(p) for p in pages]
    return ["\n".join(t for (_, t, _), y in zip(page, keep) if y) for page, keep in zip(found, model.label(found))]


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(0), PAGE_BYTES):
                part, raw = batch.slice(a, b - a), data.tobytes()
                texts = main_text(model.value, [raw[x:y].decode() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())])
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*part.schema.names[1:], "text", "n_chars"])

    rest = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (column, "text", "n_chars")])
    fields = "".join(f"`{c}` {t}, " for c, t in rest.dtypes)
    return leading(pages, column, rest.columns).mapInArrow(run, fields + "text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
