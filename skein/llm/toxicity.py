"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a hashed word embedding next to the mean of its hashed character n-gram embeddings. The network runs
over overlapping windows of WINDOW words, STRIDE apart, that cover the whole text; attention pools a window's states
to one logit, and a text's score is the calibrated maximum over all its windows. Training is multiple-instance: only
the window that scores highest carries a document's label. The model (about 1 MB) is fitted on the driver from a
bounded sample of labelled rows and sent with the function; scoring runs in Arrow batches, and each distinct word of a
batch is projected once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import give_back, short_batches, usable_labels

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 16
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 14
GRAMS = (3, 4, 5, 6)
_CHUNK = 4096
#: Bounds of the training sample: documents of each label, and characters of one of them.
SAMPLE, SAMPLE_CHARS = 1500, 24_000


def tokenize(texts: Iterable[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word in them, number of words of each text)."""
    lists = [(t or "").lower().split() for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = pa.array([w for x in lists for w in x], pa.string())
    coded = pc.dictionary_encode(flat)
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), counts


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths): the hashed n-grams of each word between its boundaries, end to end."""
    parts = [_char_grams(words[i : i + _CHUNK]) for i in range(0, len(words), _CHUNK)]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(codes))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(words)), size)
    rolling, rows, owners = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, GRAMS[-1] + 1):
        ahead = np.zeros(len(codes), np.uint64)
        ahead[: max(len(codes) - n + 1, 0)] = codes[n - 1 :]
        rolling = rolling * np.uint64(1000003) + ahead + np.uint64(1)
        if n in GRAMS:
            fits = left >= n
            h = (rolling[fits] ^ (rolling[fits] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            rows.append((h >> np.uint64(64 - 14)).astype(np.int32))
            owners.append(owner[fits])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.bincount(owners, minlength=len(words))


def window_index(at: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index of each position of each window, document of each window). Short windows end in `pad`; a text
    without words has one empty window."""
    n = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    base = np.cumsum(counts) - counts
    pos = first[:, None] + np.arange(WINDOW)
    inside = pos < counts[doc][:, None]
    return np.where(inside, np.append(at, pad)[np.where(inside, base[doc][:, None] + pos, len(at))], pad), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, the forward pass and its gradient. Axis 0 of the recurrent ones is the direction."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        init = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.word = (rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM))).astype(np.float32)
        self.char = (rng.normal(0, 0.3, (CHAR_ROWS, CHAR_DIM))).astype(np.float32)
        self.p = {"W": init(2, d, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "U": init(2, h, 3 * h), "v": np.zeros(2 * h, np.float32), "w": (rng.normal(0, 0.3, 2 * h)).astype(np.float32), "c": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, rows: np.ndarray, grams: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The input vector of each word: its word row, and the mean of its n-gram rows."""
        total = np.zeros((len(lens), CHAR_DIM), np.float32)
        ends = np.cumsum(lens)
        for i in range(0, len(lens), _CHUNK):  # a word has about 25 n-grams, so all their rows at once are large
            first = ends[i] - lens[i]
            part = grams[first : ends[min(i + _CHUNK, len(lens)) - 1]]
            total[i : i + _CHUNK] = np.add.reduceat(self.char[part], ends[i : i + _CHUNK] - lens[i : i + _CHUNK] - first, axis=0)
        return np.hstack([self.word[rows], total / np.sqrt(np.maximum(lens, 1))[:, None].astype(np.float32)])

    def project(self, x: np.ndarray) -> np.ndarray:
        """(2, words + 1, 3 HIDDEN); the last row keeps a state as it is."""
        out = np.matmul(x, self.p["W"]) + self.p["b"]
        stay = np.zeros((2, 1, 3 * HIDDEN), np.float32)
        stay[:, :, :HIDDEN] = 40
        return np.concatenate([out, stay], axis=1)

    def states(self, table: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(WINDOW, windows, 2 HIDDEN)."""
        h, n = HIDDEN, len(index)
        out = np.empty((WINDOW, n, 2 * h), np.float32)
        s = np.zeros((2, n, h), np.float32)
        for t in range(WINDOW):
            x = np.stack([table[0, index[:, t]], table[1, index[:, WINDOW - 1 - t]]])
            a = np.matmul(s, self.p["U"])
            gates = _sigmoid(x[:, :, : 2 * h] + a[:, :, : 2 * h])
            z, r = gates[:, :, :h], gates[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + r * a[:, :, 2 * h :])
            if keep is not None:
                keep.append((s, z, r, new, a[:, :, 2 * h :]))
            s = new + z * (s - new)
            out[t, :, :h], out[WINDOW - 1 - t, :, h:] = s[0], s[1]
        return out

    def pool(self, s: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, pooled, attention) of windows."""
        e = np.where(mask, s @ self.p["v"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, s)
        return pooled @ self.p["w"] + self.p["c"][0], pooled, a

    def logits(self, table: np.ndarray, index: np.ndarray) -> np.ndarray:
        pad = table.shape[1] - 1
        out = np.empty(len(index), np.float32)
        for i in range(0, len(index), _CHUNK):
            part = index[i : i + _CHUNK]
            out[i : i + _CHUNK] = self.pool(self.states(table, part), (part != pad).T)[0]
        return out

    def gradient(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted log-loss: of the parameters, and of the input vectors `x`."""
        h, table, keep = HIDDEN, self.project(x), []
        s = self.states(table, index, keep)
        logit, pooled, a = self.pool(s, (index != len(x)).T)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["c"][0] = d @ pooled, d.sum()
        dp = d[:, None] * self.p["w"]
        da = np.einsum("tnk,nk->tn", s, dp)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", de, s)
        ds = a[:, :, None] * dp + de[:, :, None] * self.p["v"]
        dtable = np.zeros_like(table)
        back = np.zeros((2, len(index), h), np.float32)
        for t in reversed(range(WINDOW)):
            old, z, r, new, hn = keep[t]
            dh = back + np.stack([ds[t, :, :h], ds[WINDOW - 1 - t, :, h:]])
            dn = dh * (1 - z) * (1 - new * new)
            dx = np.concatenate([dh * (old - new) * z * (1 - z), dn * hn * r * (1 - r), dn], axis=2)
            dA = np.concatenate([dx[:, :, : 2 * h], dn * r], axis=2)
            g["U"] += np.matmul(old.transpose(0, 2, 1), dA)
            back = dh * z + np.matmul(dA, self.p["U"].transpose(0, 2, 1))
            np.add.at(dtable[0], index[:, t], dx[0])
            np.add.at(dtable[1], index[:, WINDOW - 1 - t], dx[1])
        dtable = dtable[:, :-1]
        g["b"] = dtable.sum(axis=1, keepdims=True)
        g["W"] = np.matmul(x.T, dtable)
        return g, np.einsum("dnk,djk->nj", dtable, self.p["W"])

    def raw(self, texts: Iterable[str | None]) -> np.ndarray:
        """The highest window logit of each text."""
        words, at, counts = tokenize(texts)
        words = words.to_pylist()
        if words:
            grams, lens = char_grams(words)
            table = self.project(self.inputs(word_rows(words), grams, lens))
        else:
            table = self.project(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))
        index, doc = window_index(at, counts, len(words))
        out = np.full(len(counts), -np.inf, np.float32)
        np.maximum.at(out, doc, self.logits(table, index))
        return out

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The calibrated probability of label 1."""
        return _sigmoid(self.scale * self.raw(texts).astype(np.float64) + self.shift)


def word_rows(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in words), np.int64, len(words))


def train(texts: list[str | None], labels: np.ndarray, prior: float | None = None, epochs: int = 12, seed: int = 5) -> Network:
    """Fits on labelled texts; one in five is kept for calibration. `prior` is the share of label 1 that scores should
    reflect. With one label only, all scores are that label."""
    net, y = Network(seed), np.asarray(labels, np.float32)
    if len(set(y.tolist())) < 2:
        net.scale, net.shift = 0.0, 40.0 if len(y) and y[0] == 1 else -40.0
        return net
    rng = np.random.default_rng(seed)
    words, at, counts = tokenize(texts)
    words = words.to_pylist()
    rows, (grams, lens) = word_rows(words), char_grams(words)
    starts = np.cumsum(lens) - lens
    index, doc = window_index(at, counts, len(words))
    first = np.searchsorted(doc, np.arange(len(y)))
    many = np.bincount(doc, minlength=len(y))
    fit = np.arange(len(y)) % 5 != 4
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    squares, step = {"word": np.full(WORD_ROWS, 1e-6, np.float32), "char": np.full(CHAR_ROWS, 1e-6, np.float32)}, 0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        chosen = first + (rng.random(len(y)) * many).astype(np.int64)
        if epoch >= 3:
            logit = net.logits(net.project(net.inputs(rows, grams, lens)), index)
            order = np.lexsort((logit, doc))
            top = order[first + many - 1]
            picked = np.concatenate([top[fit], chosen[fit & (y == 0)]])
        else:
            picked = chosen[fit]
        picked = rng.permutation(picked)
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for i in range(0, len(picked), 128):
            part = picked[i : i + 128]
            used, local = np.unique(index[part], return_inverse=True)
            local = local.reshape(-1, WINDOW)
            real = used[used < len(words)]
            n = lens[real]
            flat = grams[np.repeat(starts[real] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            x = net.inputs(rows[real], flat, n)
            drop = rng.random(len(real)) < 0.3
            x[drop, :WORD_DIM] = 0
            g, dx = net.gradient(x, local, y[doc[part]], balance[doc[part]])
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            dx[drop, :WORD_DIM] = 0
            for name, at_rows, grad in (("word", rows[real], dx[:, :WORD_DIM]), ("char", flat, np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32), n, axis=0))):
                hit, where = np.unique(at_rows, return_inverse=True)
                total = np.zeros((len(hit), grad.shape[1]), np.float32)
                np.add.at(total, where, grad)
                squares[name][hit] += (total * total).mean(axis=1)
                getattr(net, name)[hit] -= 5 * rate * total / np.sqrt(squares[name][hit])[:, None]
    logit = net.logits(net.project(net.inputs(rows, grams, lens)), index)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, doc, logit)
    share = y.mean() if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    net.scale, net.shift = platt(top[~fit], y[~fit], share)
    return net


def platt(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 60) -> tuple[float, float]:
    """Scale and shift of a logistic calibration by Newton steps, classes weighted to `prior`, lightly regularised."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    z, t = np.column_stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
    reg = np.array([0.05, 1e-6])
    for _ in range(rounds):
        p = _sigmoid(z @ t)
        grad = z.T @ (weight * (p - y)) + reg * (t - np.array([1.0, 0.0]))
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(reg)
        move = np.linalg.solve(hess, grad)
        t = t - np.clip(move, -1, 1)
    return float(max(t[0], 1e-3)), float(t[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, longest: int = SAMPLE_CHARS) -> tuple[list[str | None], np.ndarray, float]:
    """(texts, labels, share of label 1 among all usable labels). The sample is the `sample` labelled rows of each label
    with the smallest hash of doc_id, of those of at most `longest` characters (null texts count as empty); longer texts
    are scored like any other.

    Unusable: null ids, labels other than 0 and 1, and ids that have both labels. Rows that repeat a label count once;
    rows that repeat an id with other texts are all used."""
    short_batches(docs.sparkSession)
    known = usable_labels(labels, label, doc_id)
    share = known.agg(F.avg("_y")).first()[0] or 0.0
    picks = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_d"), "_d").limit(2 * sample) for y in (0, 1)]
    picks = picks[0].unionByName(picks[1])
    # At most 4 * sample short rows: a proven bound, so the documents are not shuffled.
    texts = docs.select(F.col(doc_id).alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("_t")).where(F.length("_t") <= longest)
    got = texts.join(F.broadcast(picks), "_d").select("_d", "_y", "_t")
    got = [got.where(F.col("_y") == y).orderBy(F.xxhash64("_d"), "_d", F.xxhash64("_t")).limit(sample).collect() for y in (0, 1)]
    rows = sorted((r for part in got for r in part), key=lambda r: (zlib.crc32(str(r["_d"]).encode()), str(r["_d"]), r["_t"]))
    return [r["_t"] for r in rows], np.array([r["_y"] for r in rows]), share


def score(text: Column, net: Network) -> Column:
    """The toxicity of a text, 0 to 1. Null counts as empty; an empty text has the score of an empty window. Equal texts
    have equal scores; of a text of any length all windows are scored, a bounded number at a time."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        parts = [net.scores(texts.slice(i, 500).to_pylist()) for i in range(0, len(texts), 500)]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return of(text)
