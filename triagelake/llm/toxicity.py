"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by the gap-weighted subsequence kernel (lengths 3 and 4), so inserted or dropped characters
and unseen endings lower the similarity a little and not to nothing.  Letters spelt apart ("i d i o t") are read
as one word.  Landmarks are words of toxic training documents; a word's kernel values to them, whitened by the
landmarks' own kernel matrix, are its Nyström features.  A sentence stands for its worst word and a document for its
worst sentence, so the machine's training rows are worst words: of each toxic document those of its most suspicious
sentences (chosen again after each fit), and all words of clean documents, as their sentences are clean.  Values are
mapped to 0..1 by a logistic fit; the boundary comes from two-fold cross-validation inside the training texts.

A kernel value counts only if the word holds at least GATE of the landmark's adjacent letter pairs (gaps allowed),
in training and in use alike; below that it is zero.  Words of one or two letters and words over PIECE letters are
read as spelt-apart runs and as overlapping pieces; other one- and two-letter words have no subsequence of length 3.

Training takes at most MAX_PER_CLASS labelled documents of a class, those with the smallest hashed doc_id,
never one whose crc32 makes it held out.  Everything else reads all texts whole.

Edge cases: null and empty texts have no words and get the value of a clean sentence; without a toxic or a clean
label or if no word tells them apart, all scores are the share
of toxic labels (0 without labels); repeated rows each come out; further columns
are carried, except those named like an output; empty in, empty out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import blocks, distinct_ranges, leading, ragged, table, word_bounds

MAX_PER_CLASS = {1: 800, 0: 2000}  # training documents of each label
MAX_LANDMARKS = 48
#: Least log-likelihood ratio of a landmark's stem.
EVIDENCE = 14.0
#: Least share of toxic documents among those that hold such a stem.
PURITY = 0.8
LAMBDA, LENGTHS, PIECE, STEP, GATE = 0.6, (3, 4), 16, 8, 0.7

# Codes: 1-26 letters, 27 any other letter's byte, 0 what is skipped. Digits that stand for letters: fixed values.
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
for _digit, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}.items():
    _CODE[ord(_digit)] = ord(_letter) - 96


def word_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of a block, and first letter, length and row of its words; runs of single letters are also joined."""
    starts, ends, row = word_bounds(data, offs)
    code = _CODE[data]
    keep = code > 0
    to = np.concatenate([[0], np.cumsum(keep)])
    first, length = to[starts], to[ends] - to[starts]
    lone = np.concatenate([[False], length == 1, [False]])
    edge = np.flatnonzero(lone[1:] != lone[:-1]).reshape(-1, 2)
    for a, b in edge[edge[:, 1] - edge[:, 0] >= 4].tolist():  # words a to b - 1, cut at row ends
        for r in np.unique(row[a:b]).tolist():
            own = np.flatnonzero(row[a:b] == r) + a
            if len(own) >= 4:
                first, length, row = np.append(first, first[own[0]]), np.append(length, len(own)), np.append(row, r)
    long = np.flatnonzero(length > PIECE)
    if len(long):  # long words in overlapping pieces
        n = -(-(length[long] - PIECE) // STEP)
        of = np.repeat(long, n)
        begin = ragged(np.ones(len(long), np.int64), n) * STEP
        first = np.concatenate([first, first[of] + begin])
        tail = np.minimum(length[of] - begin, PIECE)
        row = np.concatenate([row, row[of]])
        length = np.concatenate([np.minimum(length, PIECE), tail])
    ok = length >= min(LENGTHS)
    return code[keep], first[ok], length[ok], row[ok]


def pad(letters: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(first), width), np.uint8)
    rows = np.repeat(np.arange(len(first)), length)
    out[rows, ragged(np.zeros(len(first), np.int64), length)] = letters[ragged(first, length)]
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernels of the rows of s with those of t, one column a length in LENGTHS.

    The recursion over prefixes of s, for all rows and prefixes of t at once; a code of 0 pads and matches nothing.
    """
    n, p, ls, lt = len(s), max(LENGTHS), s.shape[1], t.shape[1]
    lam = np.float32(LAMBDA)
    ahead = np.arange(lt)[None, :] - np.arange(lt)[:, None]
    decay = np.where(ahead >= 0, lam ** np.maximum(ahead, 0), 0).astype(np.float32)
    same = [((s[:, a, None] == t) & (s[:, a, None] > 0)) * (lam * lam) for a in range(ls)]
    out = np.zeros((n, len(LENGTHS)))
    low = [np.ones((n, lt + 1), np.float32)] * ls  # of shorter subsequences, for each prefix of s and of t
    for i in range(1, p + 1):
        cur = [np.zeros((n, lt + 1), np.float32)]
        total = np.zeros(n, np.float32)
        for a in range(ls):
            x = same[a] * low[a][:, :-1]
            if i in LENGTHS:
                total += x.sum(axis=1)
            if i < p:
                nxt = lam * cur[a]
                nxt[:, 1:] += x @ decay
                cur.append(nxt)
        if i in LENGTHS:
            out[:, LENGTHS.index(i)] = total
        low = cur
    return out


def by_length(s: np.ndarray, t: np.ndarray, length: np.ndarray, width: int, step: int = 1024) -> np.ndarray:
    """kernel() of rows taken in order of length, so that short words pay for short words only."""
    out = np.zeros((len(s), len(LENGTHS)))
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):
        most = length[order[a]] + 1
        b = min(a + step, int(np.searchsorted(length[order], most, "right")))
        at = order[a:b]
        n = int(length[at].max())
        out[at] = kernel(s[at, :n], t[at, : min(width, n) if t is s else width])
        a = b
    return out


def self_kernel(s: np.ndarray, length: np.ndarray) -> np.ndarray:
    return by_length(s, s, length, s.shape[1])


class Landmarks:
    """The landmark words with their gates: a word is compared if it holds most adjacent letter pairs of a landmark,
    with up to two letters between them."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = [np.frombuffer(bytes(map(ord, w)), np.uint8) for w in words]
        self.codes = pad(np.concatenate(codes), np.cumsum([0] + [len(c) for c in codes])[:-1], np.array([len(c) for c in codes]), PIECE)
        self.length = np.array([len(c) for c in codes])
        self.own = self_kernel(self.codes, self.length)
        self.lut = np.zeros((-(-len(words) // 4), 28 * 28), np.uint64)  # a word of 16 letters has 15 pairs: 16 bits each
        self.need = np.zeros(len(words), np.int64)
        for m, c in enumerate(codes):
            pairs = list(dict.fromkeys(zip(c[:-1].tolist(), c[1:].tolist())))
            self.need[m] = max(2, int(np.ceil(GATE * len(pairs))))
            for bit, (x, y) in enumerate(pairs):
                self.lut[m // 4, x * 28 + y] |= np.uint64(1 << (16 * (m % 4) + bit))

    def features(self, letters: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that pass a gate, and their kernel values to all landmarks (0 where gated out)."""
        begin = np.cumsum(length) - length
        flat = letters[ragged(first, length)].astype(np.int64)
        left = np.repeat(begin + length, length) - np.arange(len(flat))  # letters to the word's end
        held = np.zeros((len(first), len(self.need)), np.uint8)
        for g, lut in enumerate(self.lut):
            seen = np.zeros(len(first), np.uint64)
            for gap in (1, 2, 3):
                if len(flat) <= gap:
                    continue
                bits = np.zeros(len(flat), np.uint64)
                bits[:-gap] = lut[flat[:-gap] * 28 + flat[gap:]]
                bits[left <= gap] = 0
                seen |= np.bitwise_or.reduceat(bits, begin)
            part = seen.view(np.uint16).reshape(-1, 4)[:, : len(self.need) - 4 * g]
            held[:, 4 * g : 4 * g + part.shape[1]] = np.bitwise_count(part)
        word, mark = np.nonzero(held >= self.need)
        some, at = np.unique(word, return_inverse=True)
        out = np.zeros((len(some), len(self.need)))
        if len(some):
            padded = pad(letters, first[some], length[some], PIECE)
            own = self_kernel(padded, length[some])
            for m in np.unique(mark).tolist():
                i = at[mark == m]
                v = by_length(padded[i], np.broadcast_to(self.codes[m], (len(i), PIECE)), length[some[i]], int(self.length[m]))
                scale = np.sqrt(own[i] * self.own[m])
                out[i, m] = (v / np.where(scale > 0, scale, 1)).mean(axis=1)
        return some, out


class Model:
    """word value = features · alpha + bias; document score = logistic(slope · worst word value + shift)."""

    def __init__(self, marks: Landmarks | None, alpha=None, bias: float = 0.0, slope: float = 0.0, shift: float = 0.0):
        self.marks, self.alpha, self.bias, self.slope, self.shift = marks, alpha, bias, slope, shift

    def values(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The worst word's value of each row; rows without words have the bias."""
        out = np.full(len(offs) - 1, self.bias)
        if self.marks is None or not len(data):
            return out
        letters, first, length, row = word_codes(data, offs)
        if len(first):
            one, back = distinct_ranges(letters, first, first + length)
            some, f = self.marks.features(letters, first[one], length[one])
            value = np.full(len(one), self.bias)
            value[some] += f @ self.alpha
            np.maximum.at(out, row, value[back])
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.values(data, offs) + self.shift, -30, 30)))


def _word_ids(texts: list[str], ids: dict[str, int]) -> list[np.ndarray]:
    """Each text's coded words in order, as numbers given out by ids (0: none)."""
    out = []
    for t in texts:
        d = np.frombuffer(t.encode(), np.uint8)
        letters, first, length, _ = word_codes(d, np.array([0, len(d)]))
        raw = letters.tobytes()
        words = (raw[a : a + n].decode("latin-1") for a, n in zip(first.tolist(), length.tolist()))
        out.append(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64))
    return out


def _surroundings(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (word before, word) pairs of all texts."""
    before = np.concatenate([np.concatenate([[0], t[:-1]]) for t in texts if len(t)] or [np.zeros(0, np.int64)])
    word = np.concatenate([t for t in texts if len(t)] or [np.zeros(0, np.int64)])
    key = np.unique(before * (n + 1) + word)
    return key // (n + 1), key % (n + 1)


def _matrix(marks: Landmarks, words: list[str], step: int = 20_000) -> np.ndarray:
    out = np.zeros((len(words), len(marks.words)), np.float32)
    for at in range(0, len(words), step):
        part = words[at : at + step]
        length = np.array([len(w) for w in part], np.int64)
        some, f = marks.features(np.frombuffer("".join(part).encode("latin-1"), np.uint8), np.cumsum(length) - length, length)
        out[at + some] = f
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active set."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        on = y * (a @ w) < 1
        left = ridge + c * (a[on] * weight[on, None]).T @ a[on]
        new = np.linalg.solve(left, c * a[on].T @ (weight[on] * y[on]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a regularised logistic fit with classes of equal weight."""
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    a = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(2)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(x)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - (y > 0))) + 0.02 * len(x) * np.array([w[0], 0])
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + 0.02 * len(x) * np.diag([1.0, 1e-6])
        w -= np.linalg.solve(hess, grad)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def _boundary(x: np.ndarray, y: np.ndarray) -> float | None:
    """The value with the fewest wrong decisions, classes of equal weight; of equally good gaps the middle of the widest."""
    values, at = np.unique(x, return_inverse=True)
    if len(values) < 2:
        return None
    bad = np.bincount(at, weights=y > 0) / max(1, (y > 0).sum())
    good = np.bincount(at, weights=y <= 0) / max(1, (y <= 0).sum())
    wrong = (np.cumsum(bad) + good.sum() - np.cumsum(good))[:-1]  # toxic at or below, clean above
    gap = np.where(wrong <= wrong.min() + 1e-9, np.diff(values), -1.0)
    k = int(gap.argmax())
    return float(values[k] + values[k + 1]) / 2


def _evidence(bad: int, good: int, share: float) -> float:
    """Log-likelihood ratio of a group's share of toxic documents against the common share; 0 if not higher."""
    n = bad + good
    p = bad / n
    if p <= max(share, PURITY):
        return 0.0
    return bad * np.log(p / share) + (good * np.log((1 - p) / (1 - share)) if good else 0.0)


def _bent(word: str) -> list[str]:
    """The word with a letter put in, and with one doubled."""
    m = len(word) // 2
    if len(word) >= PIECE:
        return []
    return [word[:m] + chr(24) + word[m:], word[:m] + word[m - 1] + word[m:]]


def _share(toxic: int, clean: int) -> Model:
    """Without landmarks every score is the share of toxic labels."""
    share = toxic / max(1, toxic + clean)
    return Model(None, shift=float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))


def _values(model: Model, texts: list[str]) -> np.ndarray:
    return np.concatenate([model.values(d, o) for _, _, d, o in blocks(pa.array(texts, pa.large_string()))] or [np.zeros(0)])


def _unseen(toxic: list[str], clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values and labels of the training texts, each half by a machine of the other half; equal texts share a half."""
    half = lambda texts, k: [t for t in texts if zlib.crc32(t.encode()) % 2 == k]
    v, y = [], []
    for k in (0, 1):
        model = fit(half(toxic, 1 - k), half(clean, 1 - k))
        if model is None:
            return np.zeros(0), np.zeros(0)
        for texts, label in ((toxic, 1.0), (clean, 0.0)):
            v.append(_values(model, half(texts, k)))
            y.append(np.full(len(v[-1]), label))
    return np.concatenate(v), np.concatenate(y)


def train(toxic: list[str], clean: list[str]) -> Model:
    """The machine of all texts, its logistic slope, and the boundary that cross-validation within these texts gives."""
    model = fit(toxic, clean)
    if model is None:
        return _share(len(toxic), len(clean))
    v, y = np.concatenate([_values(model, toxic), _values(model, clean)]), np.append(np.ones(len(toxic)), np.zeros(len(clean)))
    model.slope, model.shift = _logistic(v, y)
    middle = _boundary(*_unseen(toxic, clean))
    middle = _boundary(v, y) if middle is None else middle
    if model.slope > 0 and middle is not None:  # labels are noisy: the fit gives the slope, the decisions the midpoint
        model.shift = -model.slope * middle
    return model


def fit(toxic: list[str], clean: list[str]) -> Model | None:
    """Landmarks and machine from texts of both classes; none if a class is empty or no word tells them apart."""
    if not toxic or not clean:
        return None
    ids: dict[str, int] = {}
    bad, good = _word_ids(toxic, ids), _word_ids(clean, ids)
    vocabulary = ["", *ids]
    n = len(ids)
    # Evidence counts distinct surroundings (the word before), so that copies of a document count once. It is
    # gathered for letter groups, as a family of endings has rare members and a frequent stem.
    pairs_bad, pairs_good = _surroundings(bad, n), _surroundings(good, n)
    in_bad, in_good = (np.bincount(w, minlength=n + 1) for _, w in (pairs_bad, pairs_good))
    gram_ids: dict[str, int] = {}
    per_word = [[gram_ids.setdefault(g, len(gram_ids)) for g in dict.fromkeys(w[i : i + 4] for i in range(len(w) - 3))] for w in vocabulary]
    count = np.fromiter(map(len, per_word), np.int64, n + 1)
    flat, begin, g = np.fromiter((x for p in per_word for x in p), np.int64, int(count.sum())), np.cumsum(count) - count, max(1, len(gram_ids))

    def stems(pairs) -> np.ndarray:
        before, word = pairs
        key = np.unique(np.repeat(before, count[word]) * g + flat[ragged(begin[word], count[word])])
        return np.bincount(key % g, minlength=g)

    stem_bad, stem_good = stems(pairs_bad), stems(pairs_good)
    share = len(pairs_bad[0]) / max(1, len(pairs_bad[0]) + len(pairs_good[0]))
    stem = np.array([_evidence(int(x), int(y), share) if x else 0.0 for x, y in zip(stem_bad, stem_good)])
    grams = list(gram_ids)
    suspicion, best = {}, {}
    for i in np.flatnonzero((in_bad > 0) & (in_good == 0) & (count > 0)).tolist():
        x = max(per_word[i], key=lambda x: (stem[x], grams[x]))
        suspicion[vocabulary[i]], best[vocabulary[i]] = float(stem[x]), grams[x]
    # landmarks: the most suspicious words, a few for each stem, as long as chance is no explanation
    chosen: list[str] = []
    of_stem, explained = Counter(), Counter()
    for w in sorted(suspicion, key=lambda w: (-suspicion[w], -in_bad[ids[w]], len(w), w)):
        if len(chosen) >= MAX_LANDMARKS or suspicion[w] < EVIDENCE and len(chosen) >= 4 or suspicion[w] < EVIDENCE / 2 and chosen:
            break
        g = best[w]  # its strongest stem
        if of_stem[g] >= 3 or explained[g] > 0.5 * stem_bad[gram_ids[g]]:  # enough of this stem, or one word makes up most of it
            continue
        for x in {w[i : i + 4] for i in range(len(w) - 3)}:
            of_stem[x] += 1
            explained[x] = max(explained[x], int(in_bad[ids[w]]))
        chosen.append(w)
    if not chosen:  # no word tells the classes apart
        return None
    marks = Landmarks(chosen)
    own = _matrix(marks, chosen).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    ok = value > 1e-6 * value.max() if value.max() > 0 else value > -1
    whiten = vector[:, ok] / np.sqrt(np.maximum(value[ok], 1e-9))
    neg_f = _matrix(marks, [vocabulary[i] for i in np.flatnonzero(in_good).tolist()])
    hard = neg_f.any(axis=1)
    x_neg = np.vstack([neg_f[hard], np.zeros((1, len(chosen)))]) @ whiten
    n_neg = np.append(np.ones(int(hard.sum())), max(1.0, 0.2 * hard.sum()))
    held = np.flatnonzero(in_bad)
    words = [vocabulary[i] for i in held.tolist()]
    f_bad = _matrix(marks, words) @ whiten
    live = f_bad.any(axis=1)
    some = [at[live[at]] for at in (np.searchsorted(held, np.unique(b)) for b in bad)]
    value = np.array([suspicion.get(w, -1.0) for w in words])
    strong = np.array([suspicion.get(w, 0.0) >= EVIDENCE for w in words])
    alpha, bias = np.zeros(whiten.shape[1]), 0.0
    for _ in range(3):  # the witness words of each toxic document's toxic sentence
        witness = [i for s in some if len(s) for i in {s[value[s].argmax()], *s[strong[s]]}]
        if not witness:
            break
        bent = [v for i in sorted(set(witness)) if suspicion.get(words[i], 0) >= EVIDENCE for v in _bent(words[i])]
        f_bent = _matrix(marks, bent) @ whiten if bent else np.zeros((0, whiten.shape[1]))
        x = np.vstack([f_bad[witness], f_bent, x_neg])
        y = np.append(np.ones(len(witness) + len(bent)), -np.ones(len(x_neg)))
        weight = np.concatenate([np.full(len(witness), 1 / len(witness)), np.full(len(bent), 0.3 / max(1, len(bent))), n_neg / n_neg.sum()]) * len(witness)
        alpha, bias = fit_svm(x, y, weight)
        value = f_bad @ alpha + bias
    return Model(marks, whiten @ alpha, bias)


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of its doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def trained_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of labelled rows: MAX_PER_CLASS of a class by hashed doc_id."""
    from pyspark.sql import Window

    rows = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    take = lambda k: [r.doc_id for r in rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_CLASS[k]).collect()]
    bad, good = take(1), take(0)
    if not bad or not good:
        return _share(len(bad), len(good))
    found = docs.where(F.col("doc_id").isin(bad + good)).select("doc_id", "text").collect()
    wanted = set(bad)
    texts = sorted((r.doc_id, r.text or "") for r in found)
    return train([t for i, t in texts if i in wanted], [t for i, t in texts if i not in wanted])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double and predicted int."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = np.concatenate([m.scores(d, o) for _, _, d, o in blocks(batch.column(0))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    fields = "".join(f"`{c}` {t}, " for c, t in rest.dtypes)
    return leading(rest, "text").mapInArrow(run, fields + "score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; decided row by row, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = np.concatenate([m.scores(d, o) for _, _, d, o in blocks(batch.column(0))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(s < 0.5))

    return leading(docs, "text").mapInArrow(run, docs.schema)
