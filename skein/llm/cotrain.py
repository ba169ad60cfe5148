"""Quality classifier by co-training.

Two classifiers see different views of a document: one its text (which hashed words and word shapes it has, and how much
of it repeats), the other its metadata (hashed columns and pairs of them, numbers by their size). Over some rounds each
labels all unlabelled documents that it is confident of, for the other to learn from. A view learns log-odds of its
hashed columns from sums over all labelled and pseudo-labelled documents, taken in Spark; what reaches the driver are
these sums, as many as there are columns. A few weights over them are fitted, and so calibrated, on labelled rows kept
aside, and a logistic stack of the two calibrated views is the score.

Texts are read once: a document's columns are written down as two bytes each, and rounds and scores work on that.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import give_back, saved, short_batches, sized, usable_labels

#: Hashed columns of words, of word shapes, and of metadata; with the number of rows they make a view's counts.
WORDS, SHAPES, META = 1 << 14, 1 << 11, 1 << 12
DENSE = 5
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 3, 0.97, 0.5
#: Rows of each label kept aside for calibration, at most; all others are learnt from.
SAMPLE = 2000
#: Log-odds are smoothed by so many rows of either label, and no larger than this.
PRIOR, MOST = 1.0, 4.0
_UPPER, _LOWER, _DIGIT, _OTHER = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+"), re.compile(r"([^\w])\1+")
FEATURES = "struct<text:binary,dense:array<double>,meta:array<int>>"


def _crc(s: str, columns: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % columns


def shape(word: str) -> str:
    """A word with its runs of letters and digits shortened: 'Abc12!!' is 'Aa0!'."""
    return _OTHER.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))


def text_view(texts: Iterable[str | None]) -> tuple[list[bytes], np.ndarray]:
    """(columns, dense) of texts: the distinct columns of each, ascending, as 16-bit numbers, words before shapes; and
    how much of it repeats (distinct words, equal neighbours, lines) and its length."""
    texts = [t or "" for t in texts]
    lists = [t.split() for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    coded = pc.dictionary_encode(pa.array([w for x in lists for w in x], pa.string()))
    distinct, at = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    word = np.array([_crc(w.lower(), WORDS) for w in distinct], np.int64)
    form = np.array([WORDS + _crc(shape(w), SHAPES) for w in distinct], np.int64)
    size = len(distinct) + 1
    pairs = np.unique(doc * size + at) if len(at) else np.zeros(0, np.int64)
    seen, which = pairs // size, pairs % size
    cols = np.unique(np.concatenate([seen * (WORDS + SHAPES) + word[which], seen * (WORDS + SHAPES) + form[which]])) if len(pairs) else pairs
    ends = np.searchsorted(cols, np.arange(len(texts) + 1) * (WORDS + SHAPES))
    packed = (cols % (WORDS + SHAPES)).astype("<u2")
    same = np.bincount(doc[1:], weights=(at[1:] == at[:-1]) & (doc[1:] == doc[:-1]), minlength=len(texts)) if len(at) > 1 else np.zeros(len(texts))
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    repeats = np.array([1 - len(set(x)) / max(len(x), 1) for x in lines], float)
    dense = np.column_stack([np.bincount(seen, minlength=len(texts)) / np.maximum(n, 1), same / np.maximum(n, 1), repeats, np.log1p(n) / 10, n < 20]).astype(float)
    return [packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], dense


def meta_view(columns: Sequence[Sequence]) -> np.ndarray:
    """(rows, k) columns of the metadata: each value, numbers by their size, and each pair of values."""
    name = lambda v: f"2^{int(v).bit_length()}" if isinstance(v, (int, float)) and v == v and abs(v) < 1e18 else str(v)
    named = [[name(v) for v in c] for c in columns]
    single = [[_crc(f"{k}={v}", META) for v in c] for k, c in enumerate(named)]
    pairs = [[_crc(f"{k},{m}={v},{w}", META) for v, w in zip(named[k], named[m], strict=True)] for k in range(len(named)) for m in range(k)]
    return np.array(single + pairs, np.int64).reshape(len(single) + len(pairs), -1).T


def features(text: Column, *meta: Column) -> Column:
    """What both views see of a document. Null texts count as empty; null metadata is a value of its own. A text of any
    length is read whole."""

    @F.arrow_udf(FEATURES)
    def of(texts: pa.Array, rest: pa.Array) -> pa.Array:
        columns, packed, dense, hashed = rest.flatten(), [], [], []
        for i in range(0, len(texts), 500):
            p, d = text_view(texts.slice(i, 500).to_pylist())
            packed += p
            dense.append(d)
            hashed.append(meta_view([c.slice(i, 500).to_pylist() for c in columns]))
        give_back()
        d = np.concatenate(dense) if dense else np.zeros((0, DENSE))
        m = np.concatenate(hashed) if hashed else np.zeros((0, 1), np.int64)
        ragged = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), t))
        return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), ragged(d, pa.float64()), ragged(m, pa.int32())], ["text", "dense", "meta"])

    return of(text, F.struct(*(c.alias(f"m{i}") for i, c in enumerate(meta))))


class Batch:
    """Features of some rows as arrays."""

    def __init__(self, texts: pa.Array, dense: pa.Array, meta: pa.Array) -> None:
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False) // 2
        self.n = len(texts)
        self.row = np.repeat(np.arange(self.n), size)
        self.cols = np.frombuffer(b"".join(texts.to_pylist()), "<u2").astype(np.int64)
        self.dense = dense.flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1)
        self.meta = meta.flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def stack(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 0.02, rounds: int = 80) -> np.ndarray:
    """Logistic weights of the columns of `z`, the last for a constant, by damped Newton steps."""
    z = np.column_stack([z, np.ones(len(z))])
    weight = weight / weight.sum() * len(y)
    t = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ t)
        r = np.diag([reg] * (len(t) - 1) + [1e-6])
        t = t - np.clip(np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + r, z.T @ (weight * (p - y)) + r @ t), -1, 1)
    return t


def log_odds(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of columns, from how many rows of label 0 and 1 have one (2, columns) of how many there are (2)."""
    share = (counts + PRIOR) / (rows[:, None] + 2 * PRIOR)
    return np.clip(np.log(share[1]) - np.log(share[0]), -MOST, MOST)


class CoTrained:
    """The two views' log-odds, the weights over them, and those of their stack."""

    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.text_odds, self.meta_odds = np.zeros(WORDS + SHAPES), np.zeros(META)
        self.views: list[np.ndarray] | None = None
        self.top = np.array([0.0, 0.0, 30.0 if prior >= 1 else -30.0])

    def told(self, b: Batch) -> list[np.ndarray]:
        """What each view's weights apply to: mean log-odds of words and of shapes with the dense columns; log-odds of
        each metadata column."""
        form = b.cols >= WORDS
        mean = lambda hit: np.bincount(b.row[hit], self.text_odds[b.cols[hit]], b.n) / np.maximum(np.bincount(b.row[hit], minlength=b.n), 1)
        return [np.column_stack([mean(~form), mean(form), b.dense]), self.meta_odds[b.meta]]

    def logits(self, b: Batch) -> list[np.ndarray]:
        if self.views is None:
            return [np.zeros(b.n), np.zeros(b.n)]
        return [z @ w[:-1] + w[-1] for z, w in zip(self.told(b), self.views, strict=True)]

    def scores(self, b: Batch) -> np.ndarray:
        """(rows, 3) calibrated probabilities of label 1: by the text, by the metadata, by both."""
        t, m = self.logits(b)
        return np.column_stack([sigmoid(t), sigmoid(m), sigmoid(self.top[0] * t + self.top[1] * m + self.top[2])])

    def calibrate(self, told: list[np.ndarray], y: np.ndarray) -> None:
        share = min(max((y == 1).mean(), 1e-3), 1 - 1e-3)
        prior = min(max(self.prior, 1e-3), 1 - 1e-3)
        weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
        self.views = [stack(z, y, weight) for z in told]
        self.top = stack(np.column_stack([z @ w[:-1] + w[-1] for z, w in zip(told, self.views, strict=True)]), y, weight)


def _counted(rows: DataFrame, model: CoTrained) -> dict[tuple[int, int], float]:
    """Weighted rows by (column, label) over all of `rows` (text, dense, meta, y, aside): text columns, then metadata
    columns, then the rows of the text view and of the metadata view. A labelled row counts for both views, others for
    the view that the other one is confident for; rows kept aside don't count."""
    total = WORDS + SHAPES + META + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, total))
        for batch in batches:
            b = Batch(batch.column(0), batch.column(1), batch.column(2))
            y = batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
            p = [sigmoid(z) for z in model.logits(b)] if model.views is not None else [np.full(b.n, 0.5)] * 2
            for view in (0, 1):
                other = p[1 - view]
                for label in (0, 1):
                    sure = other >= CONFIDENT if label else other <= 1 - CONFIDENT
                    w = np.where(y == label, 1.0, np.where((y < 0) & sure, PSEUDO_WEIGHT, 0.0))
                    if view == 0:
                        counts[label, : WORDS + SHAPES] += np.bincount(b.cols, w[b.row], WORDS + SHAPES)
                    else:
                        counts[label, WORDS + SHAPES : -2] += np.bincount(b.meta.reshape(-1), np.repeat(w, b.meta.shape[1]), META)
                    counts[label, total - 2 + view] += w.sum()
        label, column = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int32)), pa.array(label.astype(np.int32)), pa.array(counts[label, column])], ["c", "y", "w"])

    summed = rows.where("NOT aside").select("text", "dense", "meta", "y").mapInArrow(run, "c int, y int, w double")
    return {(r["c"], r["y"]): r["w"] for r in summed.groupBy("c", "y").agg(F.sum("w").alias("w")).collect()}


def _told(rows: DataFrame, model: CoTrained) -> tuple[list[np.ndarray], np.ndarray]:
    """What the views tell of the rows kept aside, in a fixed order, and their labels: a few numbers a row."""

    @F.arrow_udf("struct<a:array<double>,b:array<double>>")
    def of(texts: pa.Array, dense: pa.Array, meta: pa.Array) -> pa.Array:
        a, b = model.told(Batch(texts, dense, meta))
        return pa.array([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.struct([("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64()))]))

    got = rows.where("aside").select("h", "y", of("text", "dense", "meta").alias("z")).collect()
    got.sort(key=lambda r: (r["h"], r["y"], r["z"]["a"], r["z"]["b"]))
    return [np.array([r["z"][k] for r in got]) for k in ("a", "b")], np.array([r["y"] for r in got])


def fit(seen: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", found: str = "features", rounds: int = ROUNDS, sample: int = SAMPLE) -> CoTrained:
    """Fits on all rows of `seen` (doc_id, features): the labelled ones and, by pseudo-labels, all others.

    Of the labelled rows, every fifth by the hash of its id, up to `sample` of each label, is kept aside for
    calibration; only what the views tell of these is collected. Unusable labels (null ids, values other than 0 and 1,
    ids with both) leave their rows unlabelled; rows with a null id are unlabelled too. If only one label is there, all
    scores are that label; without any, 0. Rows that repeat an id count each time.
    """
    known = saved(usable_labels(labels, label, doc_id))
    prior = known.agg(F.avg("_y")).first()[0] or 0.0
    model = CoTrained(prior)
    if not 0 < prior < 1:
        return model
    h = F.xxhash64("_d")
    fifth = known.where(F.pmod(h, F.lit(5)) == 4)
    pick = lambda rows: [rows.where(F.col("_y") == y).orderBy(h, "_d").limit(sample).select("_d") for y in (0, 1)]
    aside = pick(fifth)
    if any(a.isEmpty() for a in aside):  # too few labels to keep some aside: calibrated on what is learnt from
        aside = pick(known)
    # At most 2 * sample ids: a proven bound.
    aside = F.broadcast(aside[0].unionByName(aside[1]).withColumn("_a", F.lit(True)))
    known = saved(known.join(aside, "_d", "left").select("_d", "_y", F.coalesce("_a", F.lit(False)).alias("_a")))
    rows = seen.select(F.col(doc_id).alias("_i"), f"{found}.*").join(sized(known), F.col("_i") == F.col("_d"), "left")
    rows = saved(rows.select("text", "dense", "meta", F.col("_y").alias("y"), F.coalesce("_a", F.lit(False)).alias("aside"), F.xxhash64("_i").alias("h")))
    if rows.where("aside").select("y").distinct().count() < 2:  # documents of one label, or of none, are there
        only = rows.where("y IS NOT NULL").agg(F.avg("y")).first()[0]
        if only is None or not 0 < only < 1:
            return CoTrained(float(only or 0.0))
        rows = rows.withColumn("aside", F.col("y").isNotNull() & F.lit(True))
    learnt = rows if any(r[0] for r in rows.where("y IS NOT NULL").select(~F.col("aside")).distinct().collect()) else rows.withColumn("aside", F.lit(False))
    for _ in range(rounds + 1):
        sums = _counted(learnt, model)
        counts = np.zeros((2, WORDS + SHAPES + META + 2))
        for (c, y), w in sums.items():
            counts[y, c] = w
        model.text_odds = log_odds(counts[:, : WORDS + SHAPES], counts[:, -2])
        model.meta_odds = log_odds(counts[:, WORDS + SHAPES : -2], counts[:, -1])
        model.calibrate(*_told(rows, model))
    return model


def score(model: CoTrained, found: Column) -> Column:
    """(text_score, meta_score, score) of a document's features."""

    @F.arrow_udf("struct<text_score:double,meta_score:double,score:double>")
    def of(texts: pa.Array, dense: pa.Array, meta: pa.Array) -> pa.Array:
        p = model.scores(Batch(texts, dense, meta))
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(3)], ["text_score", "meta_score", "score"])

    return of(found["text"], found["dense"], found["meta"])
