"""Operator 7 - quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; the unlabelled side is web text drawn from all documents.  A small
network minimises the non-negative unbiased risk ``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))`` with logistic
loss, where p is the class prior.  The prior is estimated from trusted positives and unlabelled text alone: a network is fit to
one half of both, the other half is scored, and p is the least ratio, over all thresholds, of the share of unlabelled rows
to the share of trusted rows scored above (with a margin for few rows), since good text makes up no more than that.

Bounds: ``MAX_ROWS`` positives and as many unlabelled rows, both in order of a hash of the id.  Labels of held-out rows are
never read, and labels of bad rows only for the share of good ones that the model reports beside the estimate.  Scoring reads whole texts and needs no shuffle.

Edge cases: null and empty texts are scored like any other (features of a text without words); without positives the score
is 0.5; a document labelled twice counts as good if either says so; rows may repeat; other columns are kept, one named
``score`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, without
from .toxicity import labelled, one_text

MAX_ROWS = 8_000
SYMBOL, MARK = re.compile(r"[^\w\s.,;:!?'\"()\-]"), re.compile(r"[^\w\s]")
CAPITAL, DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d")
#: Frequent function words of the corpus' languages.
STOP = frozenset("the of and to in a is that it for on with as was by der die das und in zu den von mit auf le la les de et un une du des que el los las y en con por para".split())


def describe(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    counts, n, size = Counter(words), max(1, len(words)), max(1, len(text))
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum())
    odd = sum(c for w, c in counts.items() if SYMBOL.search(w))
    loud = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    alone = sum(c for w, c in counts.items() if not any(map(str.isalnum, w[:3])))
    again = sum(map(operator.eq, words, words[1:]))
    again2 = sum(map(operator.eq, words, words[2:]))
    lines = [x for x in text.split("\n") if x]
    several = Counter(lines)
    bad_line = max((len(SYMBOL.findall(x)) / len(x) for x in several if len(x) > 20), default=0.0)
    return [
        np.log1p(len(words)), len(counts) / n, max(counts.values(), default=0) / n, again / n, again2 / n, marked / n, odd / n, loud / n, alone / n,
        sum(counts[w] for w in STOP if w in counts) / n, len(SYMBOL.findall(text)) / size, len(MARK.findall(text)) / size, len(CAPITAL.findall(text)) / size, len(DIGIT.findall(text)) / size,
        sum(map(len, counts)) / max(1, len(counts)), 1 - len(several) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))), bad_line, text.count("!!") / n, text.count("|") / n,
    ]


class Network:
    """One hidden layer; trained on the non-negative positive-unlabelled risk by Adam from a seed."""

    def fit(self, good: np.ndarray, mixed: np.ndarray, prior: float, hidden: int = 24, epochs: int = 80, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4, seed: int = 11) -> Network:
        rnd = np.random.default_rng(seed)
        both = np.concatenate([good, mixed])
        self.mean, self.std = both.mean(axis=0), both.std(axis=0) + 1e-6
        good, mixed = self._scaled(good), self._scaled(mixed)
        d = good.shape[1]
        self.w = [rnd.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rnd.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        rounds = max(1, -(-len(mixed) // batch))
        for _ in range(epochs):
            for at in np.array_split(rnd.permutation(len(mixed)), rounds):
                p = good[rnd.integers(0, len(good), min(batch, max(len(good), 1)))]
                u = mixed[at]
                (fp, hp), (fu, hu) = self._run(p), self._run(u)
                sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                # Gradients of the logistic losses: of softplus(-f) it is s - 1, of softplus(f) it is s.
                if negative >= 0:
                    gp, gu = (prior * (sp - 1) - prior * sp) / len(p), su / len(u)
                else:  # the estimate went below zero: step back from it instead
                    gp, gu = prior * sp / len(p), -su / len(u)
                grads = [decay * self.w[0], 0, decay * self.w[2], 0]
                for x, h, g in ((p, hp, gp), (u, hu, gu)):
                    back = np.outer(g, self.w[2]) * (1 - h**2)
                    for k, part in enumerate((x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]))):
                        grads[k] = grads[k] + part
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.std, -6, 6)

    def _run(self, x):
        h = np.tanh(x @ self.w[0] + self.w[1])
        return np.clip(h @ self.w[2] + self.w[3][0], -30, 30), h

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._run(self._scaled(x))[0]))


def estimated_prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """The share of good rows in ``mixed``, from rows known to be good: best bin of held-out scores."""
    ranker = Network().fit(good[::2], mixed[::2], 0.5, epochs=40)
    p, u = ranker.score(good[1::2]), ranker.score(mixed[1::2])
    if not len(p) or not len(u):
        return 0.5
    cuts = np.unique(np.quantile(np.concatenate([p, u]), np.linspace(0, 0.98, 200)))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    share_p, share_u = np.maximum(above(p), 1e-9), above(u)
    margin = 0.5 * (len(u) ** -0.5 + len(p) ** -0.5)
    best = int(((share_u + margin) / share_p).argmin())
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    sample = labelled(docs, labels, "quality", 2 * max_rows)
    # The unlabelled side: ids are cheap to rank, and max_rows bounds what is broadcast.
    some = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(max_rows).distinct()
    web = one_text(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).select("text", F.lit(-1).alias("y"), F.xxhash64("doc_id").alias("h"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"x": [describe(t) for t in batch.text], "y": batch.y, "h": batch.h})

    got = sample.select("text", "y", "h").unionByName(web).mapInPandas(run, "x array<double>, y int, h long").toPandas().sort_values(["y", "h"])
    pick = lambda y: np.array(got.x[got.y == y].tolist())
    good, bad, mixed = pick(1)[:max_rows], pick(0), pick(-1)
    if not len(good) or not len(mixed):
        return {"constant": 0.5}
    prior = estimated_prior(good, mixed)
    share = float((got.y == 1).sum() / ((got.y == 1).sum() + len(bad)))
    return {"network": Network().fit(good, mixed, prior), "prior": prior, "label_share": share}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` between 0 and 1."""
    docs = without(docs, "score")
    if "constant" in model:
        return docs.withColumn("score", F.lit(model["constant"]))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model["network"].score(np.array([describe(t) for t in text])) if len(text) else [], dtype=float)

    return docs.withColumn("score", scored("text"))
