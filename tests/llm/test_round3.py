"""Whitening, language-model scoring and conversation repair against brute force, with their edge cases."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnway.llm import bpe, common, lm_scoring, quality, queries, repair, topk_search, toxicity, warc, whitening

SF = "/root/testdata/sf0.001"


# -- whitening -----------------------------------------------------------------------------------------------------------
def brute_whitening(rows, k=4):
    """Per row that takes part, in order: id, exact deviation, projections; and n, shares of the trace, all with plain matrices."""
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, dtype=float) - np.array(s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    e, u = e[order], u[:, order]
    return [(i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)) for i, x in fine], n, e / np.trace(centred.T @ centred / n)


def check_whitening(rows, got):
    want, n, shares = brute_whitening(rows)
    by_row = defaultdict(list)
    for r in got:
        by_row[r.vec_id, r.deviation].append(r)
    assert sorted((str(i), d) for i, d in by_row) == sorted({(str(i), d) for i, d, _ in want}) and len(got) == len(shares) * len(want)
    sign = None
    for i, deviation, y in want:
        mine = {r.component: r for r in by_row[i, deviation]}
        have = np.array([mine[k + 1].whitened for k in range(len(shares))])
        sign = np.sign(have * y) if sign is None else sign
        assert np.allclose(have, sign * y, atol=1e-9)
        assert all(r.n == n and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine.values())


@pytest.mark.parametrize("tile, row_block", [(32, 4096), (7, 50)])
def test_whitening_equals_plain_matrices(spark, tile, row_block):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(9001, None), (9002, [1.0, None, *[0.0] * 62]), (9003, [float("nan")] * 64), (9004, [float("inf")] * 64), (None, rows[0][1]), (7, rows[3][1]), *[(8000 + i, rows[5][1]) for i in range(99)]]
    table = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<float>, whitened double")
    check_whitening(rows, whitening.whiten(table, tile=tile, row_block=row_block).collect())


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, queries.queries()["op11_embedding_whitening"](spark, SF).collect())


def test_whitening_without_variance_large_entries_and_lengths(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert of([]) == [] and of([(1, None), (2, [])]) == []
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in of([(1, [2.0, 2.0]), (2, [2.0, 2.0])])] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)] * 2
    mixed = of([(1, [1e38, 2.0, 3.0]), (2, [0.0, 1.0, 5.0]), (3, [0.5, 0.1]), (4, [-0.0, 1.0, 5.0])])
    assert Counter(r.vec_id for r in mixed) == {1: 3, 2: 3, 3: 2, 4: 3}
    assert {r.n for r in mixed if r.vec_id != 3} == {2} and all(r.deviation is None for r in mixed if r.vec_id != 3)
    # Beyond what 64 bits of a sum of products hold, but not beyond the result's range.
    x = [(i, [float(v), 1.0]) for i, v in enumerate([3_000_000, -3_000_000, 0])]
    assert {r.vec_id: r.deviation for r in of(x)} == {i: (3 * 256 * int(v[0])) ** 2 for i, v in x}


# -- language-model scoring -------------------------------------------------------------------------------------------------
def words_of(text):
    return (text or "").encode().lower().split()


def brute_base(rows):
    """Known tokens and base score of each row, counted plainly."""
    train = [w for i, t in rows if i is None or crc32(str(i).encode()) % 5 != 1 for w in [*words_of(t), b""]]
    c = Counter(train)
    n, v = len(train), len(c)
    return n, [(len(words_of(t)) + 1, sum(c[w] > 0 for w in [*words_of(t), b""]), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words_of(t), b""])) for _, t in rows]


def sentences(rnd, n):
    """Words that mostly follow from the word before."""
    out = ["w0"]
    for _ in range(n):
        out.append(f"w{(int(out[-1][1:]) * 7 + rnd.choice([1, 1, 1, 1, 2, rnd.randint(3, 400)])) % 400}")
    return " ".join(out)


@pytest.mark.parametrize("settings", [{}, {"block_chars": 20_000, "pairs": 2_000, "share": 0.002}])
def test_lm_counts_equal_plain_ones_and_context_pays(spark, settings):
    rnd = random.Random(3)
    rows = [(i, sentences(rnd, rnd.choice([20, 60, 400]))) for i in range(400)]
    rows += [(500, ""), (501, None), (None, "w1 w2"), (502, " \t\n"), (503, "W1 w2\x0bw3  Neu-Wort zweimal ZWEIMAL zweimal"), (503, "same id"), (504, "x" * 50_000), *[(505, "again and again")] * 3]
    got = lm_scoring.score(spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double"), **settings).collect()
    n, want = brute_base(rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((str(i), a, b, round(x, 6)) for (i, _), (a, b, x) in zip(rows, want, strict=True))
    assert {r.train_tokens for r in got} == {n}
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert all(r.score < 0 for r in got)
    usual = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(usual) > 50 and sum(r.score for r in usual) > 0.75 * sum(r.base_score for r in usual)
    # Text of another kind costs more a byte.
    strange = next(r for r in got if r.doc_id == 504)
    assert all(r.bits_per_byte * math.log10(2) == pytest.approx(-r.score / max(r.n_bytes, 1)) for r in got) and strange.n_bytes == 50_000


def test_lm_hot_pairs_dealt_out_score_alike(spark, monkeypatch):
    """A word before a third of all words: its pairs go to several buckets, and costs stay what they are."""
    monkeypatch.setattr(lm_scoring, "FIT_BUCKETS", 1000)  # weights of all buckets, however many there are
    rnd = random.Random(4)
    rows = [(i, " ".join(f"the n{rnd.randint(0, 3000)} of" for _ in range(300))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r for r in lm_scoring.score(table, pairs=10**6, share=0.9).collect()}
    dealt = {r.doc_id: r for r in lm_scoring.score(table, pairs=500, share=0.05).collect()}
    assert all(r.base_score == pytest.approx(dealt[i].base_score) and r.score == pytest.approx(dealt[i].score, rel=0.05) for i, r in plain.items())


def test_lm_probabilities_sum_to_one_at_most(spark):
    """Over all words that may follow a word, as the model has them."""
    rnd = random.Random(6)
    docs = [(i, sentences(rnd, 300)) for i in range(60)]
    train = {w.decode() for i, t in docs if crc32(str(i).encode()) % 5 != 1 for w in words_of(t)}
    held = iter(i for i in range(1000, 10**6) if crc32(str(i).encode()) % 5 == 1)
    asked = {next(held): w for w in sorted(train)}
    got = lm_scoring.score(spark.createDataFrame([*docs, *asked.items()], "doc_id long, text string")).collect()
    # One-word texts: the word at the beginning, then the end, whose share is the same for texts of an unseen pair.
    total = sum(10**r.score for r in got if r.doc_id in asked)
    assert 0 < total <= 1


def test_lm_without_training_texts_and_empty(spark):
    schema = "doc_id long, text string"
    held = [i for i in range(100) if crc32(str(i).encode()) % 5 == 1][:2]
    got = lm_scoring.score(spark.createDataFrame([(i, "a b") for i in held], schema)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 2 and all(math.isfinite(r.score) for r in got)
    assert lm_scoring.score(spark.createDataFrame([], schema)).count() == 0


def test_lm_query(spark):
    """Whole tables: base scores counted plainly, and held-out texts of a larger table cost fewer bits than by single words."""
    got = queries.queries()["op12_lm_scoring"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, want = brute_base(rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((i, a, b, round(x, 6)) for (i, _), (a, b, x) in zip(rows, want, strict=True))
    seen = [r for r in got if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


# -- conversation repair ---------------------------------------------------------------------------------------------------
BLANKS = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """Least (cost, audit) by a search over all edits, best first; ``rows`` are (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        inked = text.strip(BLANKS)
        faults.append("blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "start", ())], set()
    while True:
        cost, audit, i, at, out = heapq.heappop(heap)
        if (i, at) in done:
            continue
        done.add((i, at))
        if i == len(rows) and at in ("start", "assistant"):
            break
        role = "assistant" if at == "user" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, role, (*out, f"{role}:")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, at, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                if own[:1] == "s" and at == "start":
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, "system", (*out, f"{own}:{text}")))
                if own[:1] == role[0]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role, (*out, f"{own}:{text}")))
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, role, (*out, f"{role}:{text}")))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r[0]: tuple(r)[1:] for r in repair.repair(rows).select(*columns, repair.digest(F.col("repaired"))).collect()}


@pytest.mark.parametrize("size", [repair.SLICE, 3])
def test_repair_equals_search_over_all_edits(spark, monkeypatch, size):
    monkeypatch.setattr(repair.repaired_by, "__defaults__", (size,))
    rnd = random.Random(size)
    rows = [
        (conv, rnd.choice([None, *range(10)]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "u"]), rnd.choice(["hi.", "ok!", "yes", "", " \t", None, "what? ", "é.", "a\x0b", "no"]))
        for conv in [None, *range(250)]
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 30]))
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    assert repaired(repair.damaged(table)) == {conv: brute_repair(r) for conv, r in brute_damage(rows).items()}


def test_repair_of_nothing_long_and_repeated(spark):
    schema = "conv_id long, turn long, role string, text string, times int"
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark.createDataFrame([], schema)) == {}
    rows = [(1, 0, "user", "gone.", 0), *[(2, 1, "user", "same.", 1)] * 3]
    assert repaired(spark.createDataFrame(rows, schema)) == {1: (0, 0, 0, 0, 0, 0, "", empty), 2: brute_repair([(1, "user", "same.")] * 3)}
    # Thousands of turns of one conversation, and a very long text.
    many = [(3, i, "user" if i % 3 else "assistant", f"{i}." if i % 5 else "cut", 1) for i in range(3000)]
    got = repaired(spark.createDataFrame([*many, (4, 0, "user", "y" * 300_000 + ".", 1)], schema))
    assert got[3] == brute_repair([r[1:4] for r in many]) and got[4] == brute_repair([(0, "user", "y" * 300_000 + ".")])


# -- mended ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [1e9, 1e15, 1e20, 1e300])
def test_top_k_of_huge_components(spark, size):
    """Whole numbers of any size rank as they are; components and scores beyond a long count as its ends."""
    rnd = random.Random(7)
    rows = [(i, [rnd.uniform(-1, 1) * size for _ in range(3)] if i % 3 else [rnd.uniform(-1, 1), rnd.uniform(-1, 1) * size, -rnd.random()]) for i in range(60)]
    top = 2**63 - 1
    whole = {i: [max(-top - 1, min(top, math.floor(64 * x))) for x in v] for i, v in rows}
    want = {}
    for q in range(0, 60, 20):
        scores = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), i) for i in whole if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scores, 1)}
    out = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, shard_rows=16, block_rows=2).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out} == want


def test_one_text_of_an_id_whatever_the_order(spark):
    rows = [(1, "first text"), (1, "second text"), (2, None), (2, "x"), (3, "only")]
    got = [sorted((r.doc_id, r.text or "") for r in toxicity.one_text(spark.createDataFrame(x, "doc_id long, text string")).collect()) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 3
    assert quality.one_text is toxicity.one_text


def test_unknown_ids_are_errors(spark):
    ranks, _ = queries.tokenizer()
    for bad in (-1, 10**6):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe.decode(spark.createDataFrame([([0, bad],)], "ids array<int>"), ranks).collect()


def test_archives_are_deleted(spark):
    mine = len(common.WRITTEN)
    archives = [r.archive for r in warc.write(spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")).collect()]
    common.release(spark, since=mine)
    path = spark._jvm.org.apache.hadoop.fs.Path(archives[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
