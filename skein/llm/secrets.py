"""Secrets in texts: fixed patterns, and character Markov models for what the patterns miss.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A long token, or what a pattern leaves of one if that is as long, is a secret if its log-likelihood
ratio per character passes the threshold, which is set on labelled samples that were held out; without both letters
and digits it must pass that of ordinary names of this kind.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
_I = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among [0-9a-f]+
LONG = 16
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LONG},}}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
TYPE = "array<struct<kind:string,start:int,end:int>>"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_NAMES = (
    "user account customer order invoice payment session request response handler manager factory builder service client server config "
    "default value index count total number date time start end first last next previous current update delete insert select table column "
    "row field name type status state error message event listener thread queue stack list array map string integer double float boolean "
    "object class method function module package version release build test result report summary detail item product price quantity amount "
    "address street city country region north south east west page document text image video audio file path folder backup archive export "
    "import input output buffer stream reader writer parser encoder decoder filter search query match pattern token group member owner admin "
    "public private static final abstract interface the and that with from this have which would there their about into other under between "
    "nicht einen werden haben diese wieder zwischen arbeit zeit schule jahre leben menschen dans pour avec cette mais comme nous vous leur "
    "toujours encore monde homme femme temps para como pero sobre entre cuando donde mundo tiempo trabajo ciudad persona siempre nunca"
).split()


def samples(count: int = 6000, seed: int = 17) -> list[tuple[str, int]]:
    """Labelled samples, the same for a seed: 1 for random strings over usual alphabets, 0 for ordinary identifiers
    (words joined in the usual ways, with counters, dates and versions) and plain numbers."""
    rng = random.Random(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [digits + "abcdef", digits + "ABCDEF", digits + lower, digits + upper, digits + lower + upper, digits + lower + upper + "+/", digits + lower + upper + "-_", upper + "234567"]
    out = []
    for i in range(count):
        if i % 2:
            out.append(("".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 48))), 1))
            continue
        words = [rng.choice(_NAMES) for _ in range(rng.randint(2, 5))]
        style = rng.randrange(6)
        if style == 0:
            name = words[0] + "".join(w.title() for w in words[1:])
        elif style == 1:
            name = "".join(w.title() for w in words)
        else:
            name = rng.choice("_-/").join(words) if style < 5 else "".join(words)
        name = name.upper() if rng.random() < 0.15 else name
        tail = rng.choice(["", "", str(rng.randint(0, 9999)), f"_v{rng.randint(1, 12)}", f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"_{rng.randint(1990, 2030)}", f"/{rng.randint(1, 99)}"])
        out.append(((str(rng.randint(10**15, 10**19)) if rng.random() < 0.08 else name + tail), 0))
    return out


class MarkovModels:
    """Transition log-likelihoods of the two classes and the threshold between them."""

    def __init__(self, labelled: Iterable[tuple[str, int]], smoothing: float = 0.5) -> None:
        """Fits on four fifths of `labelled` (string, 1 if random); the rest sets the threshold: half-way between the
        best identifier and the 1 % quantile of random strings, or that quantile's end if they overlap."""
        labelled = list(labelled)
        size = len(_ALPHABET) + 2
        counts = np.full((2, size, size), smoothing)
        held = []
        for i, (text, label) in enumerate(labelled):
            if i // 2 % 5 == 4:
                held.append((text, label))
                continue
            codes = self.codes(text)
            np.add.at(counts[int(label)], (codes[:-1], codes[1:]), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]
        scores = {k: sorted(self.score(t) for t, y in held if y == k) for k in (0, 1)}
        low, high = (scores[0][-1], scores[1][len(scores[1]) // 100]) if scores[0] and scores[1] else (0.0, 0.0)
        self.threshold = max((low + high) / 2, 0.0)
        # Half-way again from there to the 10 % quantile of random strings without digits.
        plain = sorted(self.score(t) for t, y in labelled if not y and not (_DIGIT.search(t) and _LETTER.search(t)))
        wild = sorted(self.score(t) for t, y in labelled if y and not _DIGIT.search(t))
        self.strict = max(self.threshold, (plain[-1] + max(plain[-1], wild[len(wild) // 10])) / 2) if plain and wild else self.threshold

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """0 for the start and the end, then the alphabet, then one code for any other character."""
        return np.array([0, *(_ALPHABET.find(c) + 1 or len(_ALPHABET) + 1 for c in text), 0])

    def score(self, text: str) -> float:
        """The log-likelihood ratio per transition, over 0 if rather random."""
        codes = self.codes(text)
        return float(self.ratio[codes[:-1], codes[1:]].mean())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(text: str, models: MarkovModels) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start, then kind as in KINDS. Patterns and tokens are
    walked side by side, so the time is linear in the text (but for sorting the spans)."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base = _merged([(s, e) for _, s, e in found])
    at = 0
    for m in _TOKEN.finditer(text):
        start, last = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        k = at
        while start < last:
            end = min(base[k][0], last) if k < len(base) else last
            if end - start >= LONG:
                t = text[start:end]
                if models.score(t) > (models.threshold if _DIGIT.search(t) and _LETTER.search(t) else models.strict):
                    found.append(("random", start, end))
            start = max(start, base[k][1]) if k < len(base) else last
            k += 1
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(text: Column, models: MarkovModels | None = None) -> Column:
    """The secrets of a text: array of (kind, start, end) in code points, end exclusive, by start, then kind.

    The kinds assign, access and hex are fixed patterns; `random` is what the Markov models add outside them. Null
    and empty texts have none; equal texts have equal spans. Spans that start together come in the order of KINDS.
    Whole texts are scanned, in time linear in their length.
    """
    models = models or MarkovModels(samples())

    @F.arrow_udf(TYPE)
    def of(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, models)] if t else [] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return of(text)


def redact(text: Column, models: MarkovModels | None = None, mark: str = "[SECRET]") -> Column:
    """The text with every secret, overlapping ones as one, replaced by `mark`. Null stays null, an empty text empty;
    rows that repeat a text get the same one, and a text of any length is redacted whole."""
    models = models or MarkovModels(samples())

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        def clean(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for _, s, e in scan(t, models):
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return pa.array([clean(t) for t in texts.to_pylist()], pa.string())

    return of(text)
