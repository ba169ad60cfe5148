"""Analysis of text into terms, as one column expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple("a an and are as at be but by for from has have he her his i if in into is it its of on or she that the their them there these they this to was were will with you your".split())
SUFFIXES = tuple("ational iveness fulness ousness ization ation ingly edly ing ies ied ess ers er ly es s".split())
WORD = r"([\p{L}\p{N}_']+)"


def stem(t: Column) -> Column:
    """The term without its first matching suffix of SUFFIXES that leaves three characters; -ies and -ied become -y."""
    plain = [s for s in SUFFIXES if s not in ("ies", "ied")]
    ends = lambda s: F.length(t) >= len(s) + 3
    out = F.when(F.length(t) <= 3, t)
    for s in SUFFIXES:
        cut = F.left(t, F.length(t) - len(s))
        out = out.when(t.endswith(s) & ends(s), cut if s in plain else F.concat(cut, F.lit("y")))
    return out.otherwise(t)


def terms(text: Column, *, lowercase: bool = True, stopwords: Iterable[str] | None = STOPWORDS, stemmer: bool = True, min_length: int = 1) -> Column:
    """The terms of a text in order; null and empty texts have none. Stop words go before stemming."""
    body = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(body) if lowercase else body, F.lit(WORD), F.lit(1))
    stop = list(stopwords or ())
    if stop or min_length > 1:
        found = F.filter(found, lambda t: (~t.isin(*stop) if stop else F.lit(True)) & (F.length(t) >= min_length))
    return F.transform(found, stem) if stemmer else found


@dataclass(frozen=True)
class Analyzer:
    """Analysis in two steps: the words of a text, and what becomes of each. The second step runs on exploded words,
    where it is compiled; within an array it would be interpreted word by word."""

    split: Callable[[Column], Column]
    finish: Callable[[Column], Column] = lambda t: t

    def __call__(self, text: Column) -> Column:
        return F.transform(self.split(text), self.finish)


STANDARD = Analyzer(partial(terms, stemmer=False), stem)
