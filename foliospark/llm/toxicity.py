"""Toxicity by a counterfactually regularised classifier.

Logistic regression over the words of a text and the beginnings of its words, with weights
that are never negative: a long clean text doesn't outweigh an insult in it. Identity
terms are swapped in labelled sentences, and a change of the score is penalised, so that a
neutral mention of a group moves no score. The model is a bounded dictionary of weights;
it is fitted on the driver to a bounded sample of labelled rows and scored where the texts are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that are fitted at most (by a hash of their ids), features that are kept, texts that hold a feature at least.
SAMPLE_ROWS, MOST_FEATURES, LEAST_TEXTS = 6000, 4000, 4
#: Distinct features of a text that reach the driver from the sample; it is the fit alone that is bounded so.
THRESHOLD = 0.3
#: Standard errors by which a feature's share among toxic texts must differ, penalties, and steps.
LEAST_Z, RIDGE, COUNTERFACTUAL, STEPS, RATE = 5.0, 2e-5, 0.5, 400, 0.2
#: Letters of a beginning; it counts for longer words only.
BEGINNINGS = (4, 5, 6, 7)

# Identity terms, in four languages, by group that they may be swapped in.
IDENTITY = [
    "women men girls boys wives husbands mothers fathers frauen männer mädchen jungen femmes hommes filles garçons mujeres hombres chicas chicos".split(),
    "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists christen muslime juden chrétiens musulmans juifs cristianos musulmanes judíos".split(),
    "black white asian african european american latino arab indian chinese german french spanish turkish polish mexican".split(),
    "gay lesbian straight bisexual transgender queer heterosexual homosexual".split(),
    "immigrants immigrant refugees refugee foreigners foreigner migrants migrant flüchtlinge ausländer réfugiés étrangers refugiados extranjeros".split(),
    "old young elderly disabled blind deaf poor rich".split(),
]
NEUTRAL = ["my neighbours are {}", "many {} people live in this city", "the {} family next door sent a card", "a group of {} met on monday", "{} are welcome here"]

_word = re.compile(r"[^\W\d_]+")
_swap = {w: group for group in IDENTITY for w in group}


def features(text: str | None) -> set[str]:
    """The distinct words of a text, and the beginnings of longer words, marked by their length (4:abcd; 4+abcd if two words share it)."""
    words = set(_word.findall(text.lower())) if text else set()
    out = set(words)
    for n in BEGINNINGS:
        once, twice = _begun(words, n)
        out |= {f"{n}:{x}" for x in once} | {f"{n}+{x}" for x in twice}
    return out


def _begun(words: set[str], n: int) -> tuple[set[str], set[str]]:
    """Beginnings of n letters that one word has at least, and that two have."""
    once: set[str] = set()
    twice: set[str] = set()
    for w in words:
        if len(w) > n:
            x = w[:n]
            (twice if x in once else once).add(x)
    return once, twice


def counterfactual(text: str, shift: int = 1) -> str | None:
    """The text with each identity term replaced by another of its group; None without such a term."""
    changed = False

    def other(m: re.Match) -> str:
        nonlocal changed
        group = _swap.get(m[0].lower())
        if group is None:
            return m[0]
        changed = True
        return group[(group.index(m[0].lower()) + shift) % len(group)]

    out = _word.sub(other, text)
    return out if changed else None


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        swapped = [counterfactual(t) if t else None for t in f["text"]]
        yield pd.DataFrame({"label": f["label"], "own": [sorted(features(t)) for t in f["text"]], "swapped": [None if s is None else sorted(features(s)) for s in swapped]})


def _design(sets: list, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    for k, s in enumerate(sets):
        found = [index[x] for x in s if x in index]
        rows += [k] * len(found)
        cols += found
    return np.array(rows, np.int64), np.array(cols, np.int64)


def fit(own: list, swapped: list, labels: list[int]) -> dict:
    """{feature: weight}, with the intercept under ''. own: features of each text; swapped: of its counterfactual, or None."""
    y = np.array(labels, float)
    n, n1 = len(y), float(y.sum())
    if not n or n1 == 0 or n1 == n:
        return {"": -4.0 if n1 == 0 else 4.0}
    have = Counter(x for s in own for x in s)
    have1 = Counter(x for s, t in zip(own, labels) if t for x in s)
    p = n1 / n
    z = {x: (have1[x] - c * p) / np.sqrt(c * p * (1 - p)) for x, c in have.items() if c >= LEAST_TEXTS}
    chosen = sorted((x for x in z if z[x] >= LEAST_Z), key=lambda x: (-z[x], x))[:MOST_FEATURES]
    terms = sorted({x for w in _swap for x in features(w)})
    index = {x: k for k, x in enumerate(dict.fromkeys([*chosen, *terms]))}
    # Neutral sentences on every group: labelled 0, and each a counterfactual of the next.
    neutral = [features(s.format(w)) for s in NEUTRAL for group in IDENTITY for w in group]
    neutral_next = [features(s.format(group[(k + 1) % len(group)])) for s in NEUTRAL for group in IDENTITY for k, w in enumerate(group)]
    r, c = _design(own, index)
    pairs = [(a, b) for a, b in zip(own, swapped) if b is not None] + list(zip(neutral, neutral_next))
    ra, ca = _design([a for a, _ in pairs], index)
    rb, cb = _design([b for _, b in pairs], index)
    w, b = np.zeros(len(index)), float(np.log(p / (1 - p)))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        s = b + np.bincount(r, w[c], n)
        e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / n
        g = np.bincount(c, e[r], len(w)) + RIDGE * w
        d = (np.bincount(ra, w[ca], len(pairs)) - np.bincount(rb, w[cb], len(pairs))) * 2 * COUNTERFACTUAL / len(pairs)
        g += np.bincount(ca, d[ra], len(w)) - np.bincount(cb, d[rb], len(w))
        gb = float(e.sum())
        mw, vw = 0.9 * mw + 0.1 * g, 0.999 * vw + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        k, q = 1 - 0.9**t, 1 - 0.999**t
        w = np.maximum(0, w - RATE * (mw / k) / (np.sqrt(vw / q) + 1e-8))
        b -= RATE * (mb / k) / (np.sqrt(vb / q) + 1e-8)
    out = {x: float(w[k]) for x, k in index.items() if abs(w[k]) > 1e-4}
    out[""] = b
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> dict:
    """Fits labelled rows of df outside the held-out part, at most `rows` of them, chosen by a hash of their ids. Null labels are left out."""
    ids = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("label")).where("k is not null and label in (0, 1)").where(~held_out(F.col("k")))
    ids = ids.groupBy("k").agg(F.max("label").alias("label")).orderBy(F.xxhash64("k"), "k").limit(rows)
    sample = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("k")).select("id", "label", "text")
    got = sample.select("label", "text").mapInPandas(_featured, "label int, own array<string>, swapped array<string>")
    own, swapped, y = [], [], []
    for r in sorted(got.toLocalIterator(), key=lambda r: (r.label, r.own or [])):
        own.append(r.own or [])
        swapped.append(r.swapped)
        y.append(r.label)
    return fit(own, swapped, y)


def score(text: str | None, model: dict) -> float:
    """Probability of label 1; empty and null texts get the intercept's."""
    s = model[""] + sum(model.get(x, 0.0) for x in features(text))
    return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def scored(df: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of df: doc_id, held_out (null ids: false), score, predicted. Only the text decides the score."""
    known = {x: w for x, w in model.items() if x}
    words = {x for x in known if x[0].isalpha()}
    begun = [(n, *({x[2:]: w for x, w in known.items() if x.startswith(f"{n}{mark}")} for mark in ":+")) for n in BEGINNINGS]
    base = model[""]

    def one(text: str | None) -> float:
        if not text:
            return base
        found = set(_word.findall(text.lower()))
        s = base + sum(sorted(known[w] for w in found & words))
        for n, weights, again in begun:
            if weights or again:
                once, twice = _begun(found, n)
                s += sum(sorted(weights[x] for x in once & weights.keys())) + sum(sorted(again[x] for x in twice & again.keys()))
        return s

    @F.pandas_udf(T.DoubleType())
    def sigmoid(texts: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array([one(t) for t in texts], float), -30, 30))))

    return (
        df.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), sigmoid(F.col(text)).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
