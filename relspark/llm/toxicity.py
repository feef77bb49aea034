"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Each word enters as the sum of a word vector and of vectors of its character grams (beginnings and ends), so unseen
inflections of known stems are read by their characters. A GRU runs over a window in either direction, attention pools
its states, and a logit comes out. A text is scored by the largest logit of its overlapping windows, mapped to a
probability. Labels stand for whole texts: a toxic one needs one toxic window, so training takes the window that the
network finds most toxic, from both classes, and begins with log-odds of words and grams as first vectors.

Training reads a bounded sample: at most POSITIVES and NEGATIVES labelled rows in the order of a hash of the key, and of
these rows whole texts, each turned into numbers of its words as it comes. Rows whose crc32 of the key as text is divisible
by FOLDS are held out and never learnt from. The network is sent to the executors by a broadcast of at most WORDS + GRAMS
vectors.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_batches

POSITIVES, NEGATIVES = 3000, 3000
FOLDS = 5
WINDOW, STRIDE = 32, 16  # neighbours share half, so a passage of up to 17 words lies whole in a window
WORDS, GRAMS = 30_000, 30_000
DIMENSIONS, HIDDEN, ATTENTION = 8, 8, 8
EPOCHS, BATCH, RATE = 8, 128, 0.01
EDGE = ".,;:!?\"'()[]{}%$*#&|<>~_-/\\"
PAD = 0  # row of padding in gate tables


def plain(word: str) -> str:
    return word.lower().strip(EDGE)


def grams(word: str) -> list[str]:
    """Beginnings of 3 to 6 characters and ends of 3 and 4."""
    n = len(word)
    out = ["^" + word[:k] for k in (3, 4, 5, 6) if n >= k]
    return out + [word[-k:] + "$" for k in (3, 4) if n > k]


def starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """First words of the windows that cover n words; the last ends with the text."""
    if n <= window:
        return [0] if n else []
    return [*range(0, n - window, stride), n - window]


class Numbered:
    """Texts as numbers of their words, which are kept once each."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.texts: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        words, of = (text or "").split(), self.of
        self.texts.append(np.fromiter((of.setdefault(w, len(of)) for w in words), np.int32, len(words)))

    @property
    def words(self) -> list[str]:
        return list(self.of)


def occurrences(texts: list[np.ndarray], kinds: np.ndarray, most: int) -> np.ndarray:
    """Number of texts that hold each kind (most of them). kinds: the kinds of each word by its number, -1 for none."""
    out = np.zeros(most + 1, np.int64)
    for t in texts:
        out[np.unique(kinds[np.unique(t)])] += 1
    return out[:most]


class Vocabulary:
    """Vectors' rows of words and grams; row 0 is the zero vector of all that is unknown."""

    def __init__(self, numbered: Numbered, texts: list[np.ndarray], labels: np.ndarray) -> None:
        self.rows: list[dict[str, int]] = []
        self.odds: list[np.ndarray] = []
        pos, neg = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        for parts, most in ((lambda w: [w], WORDS), (grams, GRAMS)):
            of: dict[str, int] = {}
            kinds = np.full((max(1, len(numbered.of)), 6), -1, np.int32)
            for n, w in enumerate(numbered.of):
                for j, x in enumerate(parts(plain(w))):
                    kinds[n, j] = of.setdefault(x, len(of))
            b, a = (occurrences([t for t, y in zip(texts, labels, strict=True) if y == k], kinds, len(of)) for k in (0, 1))
            names = list(of)
            lo = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1))
            lo *= (a + b) / (a + b + 4)
            best = sorted(np.flatnonzero(a + b >= 3).tolist(), key=lambda i: (-abs(lo[i]), names[i]))[:most]
            self.rows.append({names[i]: n + 1 for n, i in enumerate(best)})
            self.odds.append(np.concatenate(([0.0], lo[best])))

    def index(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word, and rows of its grams (n, 6)."""
        word, gram = (r.get for r in self.rows)
        g = np.zeros((len(words), 6), np.int32)
        for i, w in enumerate(words):
            for j, x in enumerate(grams(w)):
                g[i, j] = gram(x, 0)
        return np.fromiter((word(w, 0) for w in words), np.int32, len(words)), g


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights and their gradients. x: (batch, time, dimensions), mask: (batch, time)."""

    def __init__(self, odds: list[np.ndarray], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d, h, a = DIMENSIONS, HIDDEN, ATTENTION
        self.w: dict[str, np.ndarray] = {}
        for name, lo, unit in (("word", odds[0], 0.4), ("gram", odds[1], 0.1)):
            e = rng.normal(0, 0.05, (len(lo), d))
            e[:, 0] += unit * lo
            e[0] = 0
            self.w[name] = e
        for way in "fb":
            self.w[way + "x"] = rng.normal(0, d**-0.5, (d, 3 * h))
            self.w[way + "h"] = rng.normal(0, 0.5 * h**-0.5, (h, 3 * h))
            self.w[way + "0"] = np.zeros(3 * h)
        self.w |= {"a": rng.normal(0, (2 * h) ** -0.5, (2 * h, a)), "a0": np.zeros(a), "v": rng.normal(0, a**-0.5, a), "o": rng.normal(0, (2 * h) ** -0.5, 2 * h), "o0": np.array([-1.0])}
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        self.steps = 0

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray):
        w, h = self.w, HIDDEN
        gx = x @ w[way + "x"] + w[way + "0"]
        state, out, kept = np.zeros((len(x), h)), np.zeros((*x.shape[:2], h)), []
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            gh = state @ w[way + "h"]
            zr = sigmoid(gx[:, t, : 2 * h] + gh[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gx[:, t, 2 * h :] + r * gh[:, 2 * h :])
            z = np.where(mask[:, t, None], z, 1.0)
            kept.append((t, state, z, r, n, gh[:, 2 * h :]))
            state = (1 - z) * n + z * state
            out[:, t] = state
        return out, kept

    def _back(self, way: str, x, mask, kept, d_out, grad) -> np.ndarray:
        w, h = self.w, HIDDEN
        dgx, ds = np.zeros((*x.shape[:2], 3 * h)), np.zeros((len(x), h))
        for t, state, z, r, n, gn in reversed(kept):
            ds = ds + d_out[:, t]
            dn = ds * (1 - z) * (1 - n * n)
            dz = np.where(mask[:, t, None], ds * (state - n) * z * (1 - z), 0.0)
            dr = dn * gn * r * (1 - r)
            dgx[:, t] = np.concatenate((dz, dr, dn), axis=1)
            dgh = np.concatenate((dz, dr, dn * r), axis=1)
            grad[way + "h"] += state.T @ dgh
            ds = ds * z + dgh @ w[way + "h"].T
        grad[way + "x"] += np.einsum("btd,btg->dg", x, dgx)
        grad[way + "0"] += dgx.sum((0, 1))
        return dgx @ w[way + "x"].T

    def inputs(self, word: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return self.w["word"][word] + self.w["gram"][gram].sum(axis=-2)

    def forward(self, x: np.ndarray, mask: np.ndarray):
        w = self.w
        f, kf = self._run("f", x, mask)
        b, kb = self._run("b", x, mask)
        s = np.concatenate((f, b), axis=2)
        u = np.tanh(s @ w["a"] + w["a0"])
        e = np.where(mask, u @ w["v"], -1e9)
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bts->bs", p, s)
        return pooled @ w["o"] + w["o0"][0], (kf, kb, s, u, p, pooled)

    def gradients(self, word, gram, mask, y) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss and its gradients; those of vectors are dense but few rows differ from 0."""
        w, x = self.w, self.inputs(word, gram)
        logit, (kf, kb, s, u, p, pooled) = self.forward(x, mask)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        d = (sigmoid(logit) - y) / len(y)
        grad["o"], grad["o0"] = d @ pooled, np.array([d.sum()])
        dpool = d[:, None] * w["o"]
        dp = np.einsum("bs,bts->bt", dpool, s)
        de = np.where(mask, p * (dp - (dp * p).sum(axis=1, keepdims=True)), 0.0)
        grad["v"] = np.einsum("bt,bta->a", de, u)
        du = de[:, :, None] * w["v"] * (1 - u * u)
        grad["a"], grad["a0"] = np.einsum("bts,bta->sa", s, du), du.sum((0, 1))
        ds = p[:, :, None] * dpool[:, None, :] + du @ w["a"].T
        h = HIDDEN
        dx = self._back("f", x, mask, kf, ds[:, :, :h], grad) + self._back("b", x, mask, kb, ds[:, :, h:], grad)
        dx = np.where(mask[:, :, None], dx, 0.0)
        np.add.at(grad["word"], word, dx)
        np.add.at(grad["gram"], gram, dx[:, :, None, :])
        grad["word"][0] = grad["gram"][0] = 0
        return float(np.mean(np.logaddexp(0, logit) - y * logit)), grad

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        """Adam with weight decay on the recurrent part."""
        self.steps += 1
        for k, g in grad.items():
            m, v = self.m[k]
            g = g + 1e-4 * self.w[k] if k not in ("word", "gram") else g
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            self.w[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.998**self.steps)) + 1e-8)


class Scorer:
    """Largest logit of a text's windows, many windows at a time, from gate tables of the words met (bounded)."""

    KEPT = 200_000

    def __init__(self, vocabulary: Vocabulary, network: Network, line: tuple[float, float], empty: float) -> None:
        self.vocabulary, self.line, self.empty = vocabulary, line, empty
        w, h = network.w, HIDDEN
        f4 = lambda x: np.ascontiguousarray(x, np.float32)
        self.word, self.gram = f4(w["word"]), f4(w["gram"])
        half = np.repeat([0.5, 0.5, 1.0], h)  # sigmoid(x) is taken as tanh(x / 2) / 2 + 1 / 2
        self.into = f4(np.concatenate([np.concatenate((w[k + "x"], w[k + "0"][None])) * half for k in "fb"], axis=1))
        self.back = [[f4((w[k + "h"] * half)[:, i * h : (i + 1) * h]) for i in range(3)] for k in "fb"]
        self.att, self.att0, self.v, self.o, self.o0 = f4(w["a"]), f4(w["a0"]), f4(w["v"]), f4(w["o"]), float(w["o0"][0])
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.used = 1
        self.tables = np.zeros((6, 1 << 12, HIDDEN), np.float32)
        self.tables[[0, 3], PAD] = 30.0  # update gate closed: the state stays as it is

    def index(self, words: list[str]) -> np.ndarray:
        """Rows of the words in the gate tables; new words are added."""
        rows = self.rows
        if new := set(words).difference(rows):
            todo = list(new)
            i, j = self.vocabulary.index([plain(x) for x in todo])
            x = self.word[i] + self.gram[j].sum(axis=1)
            gates = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1) @ self.into
            while self.used + len(todo) > self.tables.shape[1]:
                self.tables = np.concatenate((self.tables, np.zeros_like(self.tables)), axis=1)
            self.tables[:, self.used : self.used + len(todo)] = gates.reshape(-1, 6, HIDDEN).transpose(1, 0, 2)
            rows.update(zip(todo, range(self.used, self.used + len(todo)), strict=True))
            self.used += len(todo)
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def windows(self, index: np.ndarray) -> np.ndarray:
        """Logits of windows: index (windows, time) into the tables, PAD after the end."""
        n, t_all = index.shape
        h, states = HIDDEN, np.empty((t_all, n, 2 * HIDDEN), np.float32)
        for way in (0, 1):
            uz, ur, un = self.back[way]
            tz, tr, tn = self.tables[3 * way : 3 * way + 3]
            s = np.zeros((n, h), np.float32)
            for t in range(t_all) if way == 0 else range(t_all - 1, -1, -1):
                at = index[:, t]
                z = np.take(tz, at, axis=0)
                r = np.take(tr, at, axis=0)
                c = np.take(tn, at, axis=0)
                z += s @ uz
                r += s @ ur
                np.tanh(z, out=z)
                np.tanh(r, out=r)
                z += 1
                z *= 0.5
                r += 1
                r *= 0.5
                r *= s @ un
                c += r
                np.tanh(c, out=c)
                s = s - c
                s *= z
                s += c
                states[t, :, way * h : way * h + h] = s
        u = states.reshape(-1, 2 * h) @ self.att
        u += self.att0
        np.tanh(u, out=u)
        e = (u @ self.v).reshape(t_all, n)
        e[(index == PAD).T] = -1e9
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        return ((states @ self.o) * e).sum(axis=0) + self.o0

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """Largest window logit of each text; NaN without words."""
        if self.used > self.KEPT:
            self.clear()
        index = self.index([w for t in texts for w in t])
        ends = np.cumsum([0, *map(len, texts)])
        return self.logits_of([index[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])

    def logits_of(self, texts: list[np.ndarray]) -> np.ndarray:
        """The same of texts by rows of the gate tables."""
        out = np.full(len(texts), np.nan)
        index = np.concatenate([np.zeros(0, np.int64), *texts])
        ends = np.cumsum([0, *map(len, texts)])
        rows, first, size = [], [], []
        for i, t in enumerate(texts):
            for s in starts(len(t)):
                rows.append(i)
                first.append(ends[i] + s)
                size.append(min(WINDOW, len(t)))
        rows, first, size = np.array(rows, np.int64), np.array(first, np.int64), np.array(size, np.int64)
        steps = np.arange(WINDOW)
        for at in range(0, len(rows), 2048):
            part = slice(at, at + 2048)
            inside = steps < size[part, None]
            cells = np.where(inside, index[np.minimum(first[part, None] + steps, len(index) - 1)], PAD)
            np.fmax.at(out, rows[part], self.windows(cells).astype(float))
        return out

    def scores(self, texts: list[str | None], group: int = 2_000_000) -> np.ndarray:
        """Probabilities of whole texts, taken together up to `group` characters."""
        out, now, size = [], [], 0
        for t in texts:
            now.append((t or "").split())
            size += len(t or "")
            if size > group:
                out.append(self.logits(now))
                now, size = [], 0
        if now:
            out.append(self.logits(now))
        x = np.concatenate(out) if out else np.zeros(0)
        a, b = self.line
        return np.where(np.isnan(x), self.empty, sigmoid(a * np.nan_to_num(x) + b))


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x by Newton steps, a little ridge on the slope."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * x).sum() + 0.1 * (a - 1), g.sum()])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = max(a - step[0], 0.05), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(sample: Iterable[tuple[str, str | None, int]], rate_of_ones: float, epochs: int = EPOCHS) -> Scorer | None:
    """Fits on (key, text, label) rows, read once; every fifth of them, by hash, only sets the map to probabilities."""
    numbered, marks = Numbered(), []
    for k, t, y in sample:
        numbered.add(t)
        marks.append((y, zlib.crc32(b"check" + k.encode()) % 5 == 0))
    labels, check = np.array([m[0] for m in marks], np.int64), np.array([m[1] for m in marks], bool)
    if (labels[~check] == 1).sum() < 3 or (labels[~check] == 0).sum() < 3:
        return None
    fit = np.flatnonzero(~check & np.array([len(t) > 0 for t in numbered.texts]))
    texts = [numbered.texts[i] for i in fit]
    y = labels[fit]
    vocabulary = Vocabulary(numbered, texts, y)
    network = Network(vocabulary.odds)
    rng = np.random.default_rng(11)
    row, gram_rows = vocabulary.index([plain(w) for w in numbered.of])  # by the word's number
    begins = [np.array(starts(len(t)), np.int32) for t in texts]
    chosen = []
    for t, b in zip(texts, begins, strict=True):
        heat = np.concatenate(([0.0], np.cumsum(np.maximum(vocabulary.odds[0][row[t]], 0))))
        chosen.append(int(b[np.argmax(heat[np.minimum(b + WINDOW, len(t))] - heat[b])]))
    every, ends = np.concatenate([np.zeros(0, np.int32), *texts]), np.cumsum([0, *map(len, texts)])
    several = np.flatnonzero([len(b) > 1 for b in begins])
    sizes = np.array([len(begins[i]) for i in several], np.int64)
    windows = np.concatenate([np.zeros(0, np.int64), *(begins[i] + ends[i] for i in several)])
    for epoch in range(epochs):
        if epoch in (2, 4, 6):  # the window found most toxic stands for its text
            scorer = Scorer(vocabulary, network, (1.0, 0.0), 0.0)
            own = scorer.index(numbered.words).astype(np.int32)
            heat = np.concatenate([scorer.windows(own[every[windows[at : at + 2048, None] + np.arange(WINDOW)]]) for at in range(0, len(windows), 2048)] or [np.zeros(0)])
            for i, a, n in zip(several.tolist(), np.cumsum(sizes) - sizes, sizes, strict=True):
                chosen[i] = int(begins[i][np.argmax(heat[a : a + n])])
        order = rng.permutation(len(fit))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            word, gram, mask = np.zeros((len(some), WINDOW), np.int64), np.zeros((len(some), WINDOW, 6), np.int64), np.zeros((len(some), WINDOW), bool)
            for k, i in enumerate(some):
                s = chosen[i] if rng.random() < 0.8 or y[i] else begins[i][rng.integers(len(begins[i]))]
                part = texts[i][s : s + WINDOW]
                word[k, : len(part)], gram[k, : len(part)], mask[k, : len(part)] = row[part], gram_rows[part], True
                drop = rng.random(len(part)) < 0.3  # learn to read words by their characters, too
                word[k, : len(part)][drop] = 0
            _, grad = network.gradients(word, gram, mask, y[some])
            network.step(grad, RATE * (1 - 0.8 * epoch / epochs))
    scorer = Scorer(vocabulary, network, (1.0, 0.0), 0.0)
    own = scorer.index(numbered.words).astype(np.int32)
    x = np.concatenate([scorer.logits_of([own[t] for t in numbered.texts[at : at + 64]]) for at in range(0, len(labels), 64)])
    ones = labels.mean()
    weight = np.where(labels == 1, rate_of_ones / max(ones, 1e-9), (1 - rate_of_ones) / max(1 - ones, 1e-9))
    use = check & ~np.isnan(x)
    if min((labels[use] == 1).sum(), (labels[use] == 0).sum()) < 3:
        use = ~np.isnan(x)
    scorer.line = fit_line(x[use], labels[use], weight[use])
    scorer.empty = float(min(rate_of_ones, 0.49))
    scorer.clear()
    return scorer


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, float]:
    """The training sample (k, t, y), bounded by its rows, and the share of ones among all labelled rows that may be learnt from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~held_out(F.col(key)))
    known = known.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    n, ones = known.agg(F.count("*"), F.sum("_y")).first()
    some = [known.where(f"_y = {y}").orderBy(F.xxhash64("_k"), "_k").limit(most) for y, most in ((1, POSITIVES), (0, NEGATIVES))]
    some = some[0].unionByName(some[1])  # at most POSITIVES + NEGATIVES rows
    rows = docs.select(key, text).join(F.broadcast(some), F.col(key) == F.col("_k"))
    read = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = rows.select(F.col(key).cast("string").alias("k"), read.alias("t"), F.col("_y").alias("y"))
    return rows.orderBy(F.xxhash64("k"), "y", "t").limit(POSITIVES + NEGATIVES), (ones or 0) / max(n, 1)


def trained(rows: DataFrame, ones: float) -> bytes:
    """The pickled scorer (or None), trained in one task over the bounded sample, which spares the driver's memory."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = (r for b in batches for at in range(0, len(b), 16) for r in zip(*(c.to_pylist() for c in b.slice(at, 16).columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sample, ones))], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(fit, "model binary").first()
    return bytes(found.model) if found else pickle.dumps(None)


def annotate(docs: DataFrame, labels: DataFrame, name: str, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """docs with its score in a column of that name, which docs must not have. Edge cases as in score()."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, ones = sample(docs, labels, key, text, label)
    sent = spark.sparkContext.broadcast((trained(rows, ones), min(ones, 0.49)))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, constant = pickle.loads(sent.value[0]), sent.value[1]
        for b in batches:
            s = own.scores(b.column(at).cast(pa.string()).to_pylist()) if own else np.full(len(b), constant)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(s, 0, 1), pa.float64())], names=[*b.schema.names, name])

    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema] + [StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of each row of docs.

    Null, empty and word-less texts get the share of ones among the labels, but less than 1/2. With fewer than three
    labels of either class nothing can be learnt and every row gets that. Null labels and labels of absent texts are
    ignored, a null key is not held out, repeated rows are scored alike; other columns are ignored.
    """
    out = annotate(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), labels.withColumnRenamed(key, "k"), "score", "k", "t", label)
    return out.select(F.col("k").alias(key), F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
