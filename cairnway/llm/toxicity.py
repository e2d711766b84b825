"""Operator 3 - toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Lexicon: words and word beginnings (4 and 5 letters, for inflected stems) whose share of toxic documents stands z standard
deviations above the base rate, counted over the labelled training documents; z is what the largest of as many normal numbers as
there are terms to test would reach, sqrt(2 ln terms), and ``Z`` at most, so that few labels make a lexicon too.  Features: lexicon densities, closeness of
lexicon hits to second-person words, capitals, punctuation and obfuscation rates.  The training documents' own features use a
lexicon counted on the other half of them, so a lexicon never sees the document it describes; isotonic calibration is fit on
out-of-fold scores of the same halves.

Labels are learned only from rows that ``held_out`` does not set aside, from ``MAX_ROWS`` of them at most, taken in order of a
hash of the id; the lexicon has ``MAX_TERMS`` entries at most.  Scoring reads whole texts and needs no shuffle.

Edge cases: null and empty texts are scored like any other (their features are zeros); without labels of both classes the
score is the share of toxic labels, or 0; a document labelled twice counts as toxic if either says so; rows may repeat; other
columns are kept, one named ``score`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted, calibrated, isotonic
from .common import held_out, stored, without

MAX_ROWS, MAX_TERMS, Z, NEAR = 12_000, 2_000, 6.0, 5
#: Second-person words of the corpus' languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú usted ustedes ti tus vosotros os".split())
LEET = str.maketrans("013457@$!*", "oieastasii")
TOKEN = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"(?<![^\W\d_])[^\W\d_]+[\d@$!*]+[^\W\d_]+")
CAPITAL, MARK, CALL = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s]"), re.compile(r"[!?]{2,}")
NAMES = ("word_density", "word_hits", "stem_density", "stem_hits", "weight", "near_second", "second", "capitals", "shouted", "marks", "calls", "odd", "odd_hits", "words")


def terms(words) -> set[str]:
    """What a set of lower-case words offers to a lexicon: the words, and marked beginnings."""
    return {*words, *(f"{w[:k]}^" for w in words for k in (4, 5) if len(w) >= k)}


def describe(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    low = text.lower()
    counts = Counter(TOKEN.findall(low))
    n = max(1, sum(counts.values()))
    word_hits = stem_hits = 0
    weight, hot = 0.0, set()
    for w, c in counts.items():
        if w in lexicon:
            word_hits += c
            weight += c * lexicon[w]
            hot.add(w)
        elif len(w) > 3:
            best = max(lexicon.get(w[:4] + "^", 0.0), lexicon.get(w[:5] + "^", 0.0))
            if best:
                stem_hits += c
                weight += c * best
                hot.add(w)
    second = sum(counts[w] for w in SECOND if w in counts)
    near = 0
    if hot and second:
        words = TOKEN.findall(low)
        last = -NEAR - 1
        waiting = []
        for i, w in enumerate(words):
            if w in SECOND:
                near += sum(i - j <= NEAR for j in waiting)
                waiting, last = [], i
            if w in hot:
                if i - last <= NEAR:
                    near += 1
                else:
                    waiting = [j for j in waiting if i - j <= NEAR] + [i]
    odd = ODD.findall(low)
    odd_hits = sum(o.translate(LEET) in lexicon for o in odd)
    letters = max(1, sum(len(w) * c for w, c in counts.items()))
    capitals, size = len(CAPITAL.findall(text)), max(1, len(text))
    return [word_hits / n, np.log1p(word_hits), stem_hits / n, np.log1p(stem_hits), weight / n, near / max(1, word_hits + stem_hits), second / n, capitals / letters, float(capitals > 0.7 * letters), len(MARK.findall(text)) / size, len(CALL.findall(text)) / n, len(odd) / n, odd_hits / n, np.log1p(n)]


def one_text(rows: DataFrame, *others: str) -> DataFrame:
    """One text of each doc_id, whatever the order of rows: of several, that with the least digest."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), *[F.first(c).alias(c) for c in others])


def labelled(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """Up to ``max_rows`` training rows (text, y, fold), in order of a hash of the id; held-out labels are never read."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    # max_rows bounds what is broadcast: an id and a label each.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = one_text(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "y")
    return stored(rows.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("fold"), F.xxhash64("doc_id").alias("h")), "labelled")


def learn_lexicons(sample: DataFrame, max_terms: int = MAX_TERMS, z: float = Z) -> list[dict[str, float]]:
    """Lexicons counted on fold 0, on fold 1 and on both."""

    def count(batches):
        for batch in batches:
            seen = {}
            for text, y, fold in zip(batch.text, batch.y, batch.fold, strict=True):
                for t in terms(set(TOKEN.findall((text or "").lower()))):
                    seen.setdefault(t, [0, 0, 0, 0])[2 * fold + y] += 1
            yield pd.DataFrame([(t, *c) for t, c in seen.items()], columns=["term", "n0", "t0", "n1", "t1"])

    totals = {(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    rate = sum(v for (_, y), v in totals.items() if y) / max(1, sum(totals.values()))
    if not 0 < rate < 1:
        return [{}, {}, {}]
    counted = stored(sample.select("text", "y", "fold").mapInPandas(count, "term string, n0 long, t0 long, n1 long, t1 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")]).where("n0 + t0 + n1 + t1 > 2"), "terms")
    z = min(z, float(np.sqrt(2 * np.log(max(2, counted.count())))))
    excess = lambda clean, toxic: (toxic - (clean + toxic) * rate) / F.sqrt((clean + toxic) * rate * (1 - rate) + 1e-9)
    versions = [(F.col("n0"), F.col("t0")), (F.col("n1"), F.col("t1")), (F.col("n0") + F.col("n1"), F.col("t0") + F.col("t1"))]
    scored = counted.select("term", *[F.when((toxic >= 0.5 * (clean + toxic)), excess(clean, toxic)).otherwise(0.0).alias(f"z{i}") for i, (clean, toxic) in enumerate(versions)])
    best = scored.where(F.greatest("z0", "z1", "z2") >= z).orderBy(F.desc(F.greatest("z0", "z1", "z2")), "term").limit(max_terms).collect()
    return [{r.term: float(r[f"z{i}"]) for r in best if r[f"z{i}"] >= z} for i in range(3)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """A model: lexicon, trees and calibration."""
    sample = labelled(docs, labels, "toxic", max_rows)
    lexicons = learn_lexicons(sample)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"x": [describe(t, lexicons[1 - f]) for t, f in zip(batch.text, batch.fold, strict=True)], "y": batch.y, "fold": batch.fold, "h": batch.h})

    got = sample.mapInPandas(run, "x array<double>, y int, fold int, h long").toPandas().sort_values("h")
    y = got.y.to_numpy(dtype=float)
    if len(set(y)) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    x, fold = np.array(got.x.tolist()), got.fold.to_numpy()
    raw = np.zeros(len(y))
    for f in (0, 1):
        raw[fold == f] = Boosted().fit(x[fold != f], y[fold != f]).raw(x[fold == f]) if (fold == f).any() else 0
    knots, values = isotonic(raw, y)
    return {"lexicon": lexicons[2], "trees": Boosted().fit(x, y), "knots": knots, "values": values}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` between 0 and 1."""
    docs = without(docs, "score")
    if "constant" in model:
        return docs.withColumn("score", F.lit(model["constant"]))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([describe(t, model["lexicon"]) for t in text]).reshape(-1, len(NAMES))
        return pd.Series(calibrated(model["trees"].raw(x), model["knots"], model["values"]) if len(x) else [], dtype=float)

    return docs.withColumn("score", scored("text"))
