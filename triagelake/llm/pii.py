"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) always stay.  The model segments the tokens around digits, at-signs, bracketed
"at" and the word "dot" into outside tokens and entities of at most MAX_TOKENS tokens; REACH words on either side of
such a place are read with it, and no word is cut.  Whole-span features (digit groups, separators,
checksum, ranges, context words) score every candidate segment, and dynamic programming over positions chooses
boundaries and types jointly.  Weights are learned here by conditional likelihood on generated sentences.
Without one of these no segment is a candidate, so all other tokens are outside.

Edge cases: null and empty texts have no spans; whole texts are read, in time linear in their length; repeated
rows each come out; further columns are carried, except those named like an output; empty in, empty out.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import blocks, leading, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 17
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]|\bdot\b", re.IGNORECASE)
_SPELT = re.compile(rb"[(\[{]\s?at\s?[)\]}]|\bdot\b", re.IGNORECASE)
#: Words read on either side of such a place: more than the longest entity and its cue words have.
REACH = 20


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(t: str) -> list[Span]:
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and t[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(t, at) if start < at else None
            if m:
                out.append((0, start, m.end()))
                done = m.end()
        at = t.find("@", at + 1)
    return out


def _ips(t: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(t):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in four):
                out.append((1, at, end))
            at = end + 1
    return out


def base_spans(t: str) -> list[Span]:
    """The pattern matches that pass their tests, by kind and start."""
    out = _emails(t) + _ips(t)
    for m in _CARD.finditer(t):
        if m.end() - m.start() <= 37:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# ---- the semi-Markov model

_CUES = (  # fixed cue words, by kind
    frozenset("mail email contact write correo courriel".split()),
    frozenset("ip host server address addr adresse client".split()),
    frozenset("card visa mastercard amex karte carte tarjeta kreditkarte".split()),
    frozenset("phone tel call fax mobile telefon telephone telefono".split()),
)
_AT, _DOT, _BRACKETS = frozenset(("at", "@")), frozenset(("dot", ".")), frozenset("()[]{}")
N_TYPES = 1 + len(KINDS)  # 0 is outside


def tokens(t: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(t, start, len(t) if end is None else end)]


def span_features(toks: list[tuple[str, int, int]], i: int, j: int) -> list[int]:
    """Names of the whole-span features of tokens i to j - 1, as positions of FEATURES."""
    words = [w for w, _, _ in toks[i:j]]
    groups = [w for w in words if w[0].isdigit()]
    digits = "".join(groups)
    glued = all(toks[k][2] == toks[k + 1][1] for k in range(i, j - 1))
    marks = [w for w in words if not w[0].isalnum()]
    letters = [w for w in words if w[0].isalpha()]
    low = [w.lower() for w in letters]
    ats = words.count("@") + low.count("at")
    f = ["bias", f"digits_{min(len(digits), 20)}", f"groups_{min(len(groups), 7)}", f"tokens_{min(j - i, 9)}"]
    f.append("glued" if glued else "spaced")
    f.append(f"ats_{min(ats, 2)}")
    if ats == 1:
        k = next(k for k, w in enumerate(words) if w.lower() in _AT)
        tail = [w.lower() for w in words[k + 1 :] if w not in _BRACKETS]
        head = [w for w in words[:k] if w not in _BRACKETS]
        if head and head[0][0].isalnum() and head[-1][0].isalnum() and len(tail) > 2 and tail[0][0].isalnum() and tail[0] not in _DOT and tail[-1].isalpha() and len(tail[-1]) >= 2 and tail[-1] not in _DOT:
            seps = [w for w in tail if w in _DOT or w == "-"]
            names = sum(w[0].isalnum() and w not in _DOT for w in tail)
            if any(w in _DOT for w in seps):
                f.append("address_form" if names == len(seps) + 1 and len(tail) == names + len(seps) else "address_loose")
        if any(toks[i + x][2] != toks[i + x + 1][1] for x in range(k - 1) if words[x + 1] not in _BRACKETS):
            f.append("head_spaced")
        f.append("marked_at" if "@" in words or any(w in _BRACKETS for w in words[max(k - 1, 0) : k + 2]) else "bare_at")
        if "dot" in tail:
            f.append("spelt_dot")
        if "address_form" in f and "head_spaced" not in f:  # its form says more than its length and blanks
            f = [x for x in f if not x.startswith("tokens_") and x not in ("spaced", "bias")]
            f.append("spelt_form" if "dot" in tail else "dotted_form")
    if letters and not ats:
        f.append("letters")
    if len(groups) == 4 and marks and all(m == "." for m in marks) and len(words) == 7:
        f.append("quad_ok" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "quad_bad")
    if not letters and 13 <= len(digits) <= 19:
        f.append("luhn" if luhn(digits) else "not_luhn")
    if words[0] == "+":
        f.append("plus")
    if words[0] == "(" and ")" in words:
        f.append("area_code")
    if not letters and tuple(map(len, groups)) in ((3, 3, 4), (1, 3, 3, 4), (2, 3, 3, 4), (3, 4)):
        f.append("phone_groups")
    if not letters and groups and all(len(g) == 4 for g in groups):
        f.append("card_groups")
    kinds = {m for m in marks}
    f += [f"mark_{m}" for m in sorted(kinds) if m in "-.()+@/:,$%#=\"'"]
    if kinds - set("-.()+@[]{}_%"):
        f.append("odd_mark")
    if not (words[-1][0].isalnum() or words[-1] == ")") or not (words[0][0].isalnum() or words[0] in "+("):
        f.append("ragged_edge")
    left, right = (toks[i - 1] if i else None), (toks[j] if j < len(toks) else None)
    if left and left[2] == toks[i][1]:
        f.append("cut_left_digit" if left[0][0].isdigit() else "cut_left")
    if right and right[1] == toks[j - 1][2]:
        f.append("cut_right_digit" if right[0][0].isdigit() else "cut_right" if right[0][0].isalpha() or right[0] in "@_-/=" else "stop_right")
        if right[0] in "-." and j + 1 < len(toks) and toks[j + 1][0][0].isalnum() and toks[j + 1][1] == right[2]:
            f.append("goes_on")
    if left and left[0][0].isdigit() or i > 1 and toks[i - 1][0] in "-.(" and toks[i - 2][0][0].isdigit() and toks[i - 2][2] == toks[i - 1][1]:
        f.append("digits_before")
    near = {w.lower() for w, _, _ in toks[max(0, i - 3) : i]}
    f += [f"cue_{KINDS[k]}" for k, cues in enumerate(_CUES) if near & cues]
    return [FEATURES[x] for x in f if x in FEATURES]


_NAMES = [
    "bias", *[f"digits_{n}" for n in range(21)], *[f"groups_{n}" for n in range(8)], *[f"tokens_{n}" for n in range(1, 10)],
    "glued", "spaced", "ats_0", "ats_1", "ats_2", "address_form", "address_loose", "marked_at", "bare_at", "spelt_dot", "spelt_form", "dotted_form", "head_spaced", "letters", "quad_ok", "quad_bad", "luhn",
    "not_luhn", "plus", "area_code", "phone_groups", "card_groups", *[f"mark_{m}" for m in "-.()+@/:,$%#=\"'"], "odd_mark", "ragged_edge",
    "cut_left_digit", "cut_left", "cut_right_digit", "cut_right", "stop_right", "goes_on", "digits_before", *[f"cue_{k}" for k in KINDS],
]
FEATURES = {n: i for i, n in enumerate(_NAMES)}


def candidates(toks: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Segments (first, last + 1) that may be an entity: seven digits or an at-sign, no outer letters beyond it."""
    n = len(toks)
    digit = [len(w) if w[0].isdigit() else 0 for w, _, _ in toks]
    at = [w == "@" or w.lower() == "at" for w, _, _ in toks]
    out = []
    for i in range(n):
        w = toks[i][0]
        if not (w[0].isalnum() or w in "+("):
            continue
        d, has_at, letters = 0, False, False
        for j in range(i, min(n, i + MAX_TOKENS)):
            if j > i and toks[j][1] - toks[j - 1][2] > 1:
                break
            d += digit[j]
            has_at |= at[j]
            letters |= toks[j][0][0].isalpha() and not at[j]
            if has_at and j > i + 1 and toks[j][0][0].isalpha() or d >= 4 and not letters and not has_at and digit[j]:
                out.append((i, j + 1))
            if letters and not has_at and j - i > 6 or d > 20:
                break
    return out


class SemiCrf:
    """Weights of types by feature, and of type after type."""

    def __init__(self):
        self.w = np.zeros((N_TYPES, len(FEATURES)))
        self.t = np.zeros((N_TYPES, N_TYPES))

    def arcs(self, toks: list[tuple[str, int, int]]) -> list[tuple[int, int, list[int]]]:
        """All segments with their features: each token alone, as outside, and the candidates."""
        return [(i, j, span_features(toks, i, j)) for i, j in candidates(toks)]

    def scored(self, arcs):
        return [(i, j, self.w[1:, f].sum(axis=1)) for i, j, f in arcs]

    def best(self, toks: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
        """The highest-scoring segmentation's entities (kind, first token, last token + 1)."""
        arcs = self.arcs(toks)
        if not arcs:
            return []
        ending: dict[int, list] = {}
        for i, j, s in self.scored(arcs):
            ending.setdefault(j, []).append((i, s))
        n = len(toks)
        score = np.full((n + 1, N_TYPES), -np.inf)
        score[0, 0] = 0.0
        back: list[list] = [[None] * N_TYPES for _ in range(n + 1)]
        for j in range(1, n + 1):
            from_ = score[j - 1] + self.t[:, 0]
            k = int(from_.argmax())
            score[j, 0], back[j][0] = from_[k], (j - 1, k)
            for i, s in ending.get(j, ()):
                into = score[i][:, None] + self.t[:, 1:]
                k = into.argmax(axis=0)
                total = into[k, np.arange(N_TYPES - 1)] + s
                for y in np.flatnonzero(total > score[j, 1:]):
                    score[j, y + 1], back[j][y + 1] = total[y], (i, int(k[y]))
        out, j, y = [], n, int(score[n].argmax())
        while j > 0:
            i, before = back[j][y]
            if y:
                out.append((y - 1, i, j))
            j, y = i, before
        return out[::-1]

    def gradient(self, n: int, arcs, gold: set[tuple[int, int, int]]):
        """Log-likelihood of the gold segmentation and its gradients, by forward and backward sums."""
        segs = [(i, i + 1, 0, 0.0, None) for i in range(n)]
        for (i, j, s), (_, _, f) in zip(self.scored(arcs), arcs):
            segs += [(i, j, y + 1, float(s[y]), f) for y in range(N_TYPES - 1)]
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for x in segs:
            by_end.setdefault(x[1], []).append(x)
            by_start.setdefault(x[0], []).append(x)
        fwd, bwd = np.full((n + 1, N_TYPES), -np.inf), np.full((n + 1, N_TYPES), -np.inf)
        fwd[0, 0], bwd[n, :] = 0.0, 0.0
        add = np.logaddexp
        for j in range(1, n + 1):
            for i, _, y, s, _ in by_end[j]:
                fwd[j, y] = add(fwd[j, y], add.reduce(fwd[i] + self.t[:, y]) + s)
        for i in range(n - 1, -1, -1):
            for _, j, y, s, _ in by_start[i]:
                bwd[i] = add(bwd[i], self.t[:, y] + s + bwd[j, y])
        z = add.reduce(fwd[n])
        gw, gt, ll = np.zeros_like(self.w), np.zeros_like(self.t), -z
        for i, j, y, s, f in segs:
            into = fwd[i] + self.t[:, y] + s + bwd[j, y] - z
            p = np.exp(into)
            gt[:, y] -= p
            if f is not None:
                gw[y, f] -= p.sum()
        at, before = 0, 0
        ends = {i: (j, y) for i, j, y in gold}
        feats = {(i, j): f for i, j, f in arcs}
        while at < n:
            j, y = ends.get(at, (at + 1, 0))
            gt[before, y] += 1
            ll += self.t[before, y]
            if y:
                gw[y, feats[at, j]] += 1
                ll += self.w[y, feats[at, j]].sum()
            at, before = j, y
        return ll, gw, gt


def training_sentences(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Generated sentences with known spans, and with numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "ti", "re", "st", "ou", "le", "in", "de", "la")) for _ in range(r.randint(1, 3)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", "", " ", "-", "."))
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4)) if sep else d

    def email() -> str:
        user = word() + r.choice(("", "." + word(), num(2), "." + num(2)))
        host = word() + r.choice(("", num(1))) + r.choice((".", "-" + word() + "."))
        if r.random() < 0.6:
            at, dot = r.choice(((" (at) ", " dot "), (" [at] ", " dot "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", ".")))
            part = "" if r.random() < 0.7 else word() + dot
            return f"{user}{at}{part}{word()}{dot}{r.choice(('com', 'org', 'net'))}"
        return f"{user}@{host}{r.choice(('com', 'org', 'example.com', 'net'))}"

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}"))

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def other() -> str:
        day = f"{r.randint(1, 28):02d}"
        return r.choice((
            f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{day}", f"{day}/{r.randint(1, 12):02d}/{r.randint(1900, 2030)}", num(r.randint(1, 12)),
            f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"${num(3)},{num(3)}.{num(2)}", f"{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(300, 999)}.{num(4)}",
            "%x" % r.getrandbits(64), "AKIA" + "".join(r.choice("ABCDEFGHIJ234567") for _ in range(16)), f"password={'%x' % r.getrandbits(72)}",
            f'token = "{"%x" % r.getrandbits(160)}"', f"{num(2)}:{num(2)}:{num(2)}", f"{num(4)}-{num(4)}", f"{num(5)}-{num(4)}", f"look at {word()}.", f"look at {word()}.com", f"the dot {word()}", f"at the {word()} dot", f"dot {word()} at {word()}", f"meet at {num(1)} dot", f"{num(3)}-{num(2)}-{num(4)}",
            f"ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", num(r.choice((13, 14, 17, 18))), f"{num(1)},{num(3)},{num(3)},{num(3)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"@{word()}",
        ))

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = word().capitalize() if r.random() < 0.85 else "", []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 3)):
                text += " " + word()
            if r.random() < 0.55:
                k = r.randrange(4)
                if r.random() < 0.25:
                    text += " " + r.choice(sorted(_CUES[k])) + r.choice(("", ":"))
                s = makers[k]()
                text += " " * bool(text)
                spans.append((k, len(text), len(text) + len(s)))
                text += s
            else:
                s = other()
                if len(s.replace(" ", "")) in (14, 15, 16, 17, 18) and s.replace(" ", "").isdigit() and luhn(s.replace(" ", "")):
                    s += "x"
                text += " " + s
            text += " " + word() if r.random() < 0.9 else r.choice((".", ",", ";")) + " " + word()
        out.append((text + r.choice(("", ".", " " + word())), spans))
    return out


@lru_cache(1)
def trained(sentences: int = 400, epochs: int = 6, rate: float = 0.25, decay: float = 2e-4) -> SemiCrf:
    """The model, fitted by AdaGrad on the conditional likelihood of generated sentences."""
    model = SemiCrf()
    data = []
    for text, spans in training_sentences(sentences):
        toks = tokens(text)
        arcs = model.arcs(toks)
        have = {(i, j) for i, j, _ in arcs}
        first, last = {a: k for k, (_, a, _) in enumerate(toks)}, {b: k + 1 for k, (_, _, b) in enumerate(toks)}
        gold = {(first[a], last[b], k + 1) for k, a, b in spans}
        if all((i, j) in have for i, j, _ in gold):
            data.append((len(toks), arcs, gold))
    hw, ht = np.full_like(model.w, 1e-6), np.full_like(model.t, 1e-6)
    for _ in range(epochs):
        for n, arcs, gold in data:
            _, gw, gt = model.gradient(n, arcs, gold)
            gw -= decay * model.w
            hw += gw * gw
            ht += gt * gt
            model.w += rate * gw / np.sqrt(hw)
            model.t += rate * gt / np.sqrt(ht)
    return model


def islands(t: str) -> Iterator[tuple[int, int]]:
    """The parts of a text that may hold an entity: REACH words around each trigger, joined where they meet."""
    hits = [m.start() for m in _TRIGGER.finditer(t)]
    at = k = 0
    while k < len(hits):
        a, words = hits[k], 0
        while a > at and words < REACH:  # back to the start of a word, REACH words before
            while a > at and not t[a - 1].isspace():
                a -= 1
            words += 1
            while words < REACH and a > at and t[a - 1].isspace():
                a -= 1
        # on to REACH words behind a trigger that no other follows within 2 * REACH words
        b, to, words = hits[k], hits[k], 0
        while to < len(t) and words < 2 * REACH:
            while to < len(t) and not t[to].isspace():
                to += 1
            while to < len(t) and t[to].isspace():
                to += 1
            words += 1
            while k < len(hits) and hits[k] < to:
                k, words = k + 1, 0
            if words <= REACH:
                b = to
        yield a, b
        at = b


def model_spans(model: SemiCrf, t: str) -> list[Span]:
    """Spans that the model finds in the islands of a text."""
    out: list[Span] = []
    for a, b in islands(t):
        toks = tokens(t, a, b)
        out += [(y, toks[i][1], toks[j - 1][2]) for y, i, j in model.best(toks)]
    return out


def all_spans(model: SemiCrf, t: str, base: list[Span]) -> list[Span]:
    """The base spans, and the model's spans that overlap none of them; cards must pass their checksum."""
    held = sorted((s, e) for _, s, e in base)
    out = list(base)
    for k, s, e in model_spans(model, t):
        d = "".join(c for c in t[s:e] if "0" <= c <= "9")
        if any(a < e and s < b for a, b in held) or k == 2 and not luhn(d):
            continue
        out.append((k, s, e))
    return sorted(out)


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs without text, with counts of base spans, their digest and all spans as text."""
    new = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
    model = docs.sparkSession.sparkContext.broadcast(trained())
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, lines = np.zeros((batch.num_rows, 4), np.int64), [empty] * batch.num_rows, [""] * batch.num_rows
            for a, _, data, offs in blocks(batch.column(0)):
                mark = (data == 64) | ((data >= 48) & (data <= 57))
                mark[[m.start() for m in _SPELT.finditer(data.tobytes())]] = True
                flag = np.concatenate([[0], np.cumsum(mark)])
                for i in np.flatnonzero(flag[offs[1:]] > flag[offs[:-1]]).tolist():
                    t = data[offs[i] : offs[i + 1]].tobytes().decode()
                    base = base_spans(t)
                    for k, _, _ in base:
                        counts[a + i, k] += 1
                    digest[a + i] = hashlib.sha256(_line(base).encode()).hexdigest()
                    lines[a + i] = _line(all_spans(model.value, t, base))
            cols = [pa.array(counts[:, k]) for k in range(4)] + [pa.array(digest, pa.string()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *new])

    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in new])
    fields = "".join(f"`{c}` {t}, " for c, t in rest.dtypes)
    return leading(docs, "text", rest.columns).mapInArrow(run, fields + "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by the kind in brackets."""
    model = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(texts):
        def one(t):
            if t is None or not _TRIGGER.search(t):
                return t
            spans = sorted((s, e, k) for k, s, e in all_spans(model.value, t, base_spans(t)))
            out, at = [], 0
            for s, e, k in spans:
                if s >= at:
                    out += [t[at:s], f"[{KINDS[k]}]"]
                at = max(at, e)
            return "".join(out) + t[at:]

        return texts.map(one)

    return docs.withColumn("text", clean("text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
