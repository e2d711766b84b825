"""Every opN query and the pipeline on the smallest tables: against its SQL in DuckDB, or against brute force."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from cairnway.llm import bpe, oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in out.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name, cut", [("op3_toxicity", 0.7), ("op7_quality", 0.5)])
def test_classifier_queries(spark, duck, name, cut):
    """On the next larger tables: a few dozen labels are too few to hold a classifier to its figure."""
    larger = SF.replace("0.001", "0.01")
    out, ids = QUERIES[name](spark, larger).collect(), duck.sql(f"SELECT doc_id FROM '{larger}/documents.parquet'").fetchall()
    assert sorted(r.doc_id for r in out) == sorted(i for i, in ids)
    for r in out:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    truth = dict(duck.sql(f"SELECT doc_id, {'toxic' if name.startswith('op3') else 'quality'} FROM '{larger}/labels.parquet'").fetchall())
    known = [r for r in out if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in known) >= 0.95 * len(known)


def test_bpe_query_equals_the_library(spark, documents):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = QUERIES["op4_byte_bpe"](spark, SF).collect()
    assert len(out) == len(documents)
    for r in out:
        ids = library.encode_ordinary(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def test_mixing_query_meets_its_targets(spark, duck):
    rows = duck.sql("SELECT doc_id, source, coalesce(text, '') FROM documents").fetchall()
    size, source = {i: len(WORD.findall(t)) for i, _, t in rows}, {i: s for i, s, _ in rows}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, free, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set(order), {}
    while free:
        left, heavy = sum(total.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / heavy > 3 * total[s]}
        target |= {s: 3 * total[s] if over else left * weight[s] / heavy for s in over or free}
        free -= over or free
    out, taken = QUERIES["op6_mixing"](spark, SF).collect(), Counter()
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s)


def test_fingerprint_query(spark, documents):
    pairs = lambda t: Counter(zip(t, t[1:], strict=False)) if len(t) > 1 else Counter(t)
    words = lambda t: WORD.findall(t.lower())
    likeness = lambda a, b: (pairs(a) & pairs(b)).total() / max(1, (pairs(a) | pairs(b)).total())
    out, ids = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, SF).collect()}, sorted(documents)
    assert len(out) == len(ids)
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, following = documents[i], documents[after]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(out[i].near_edited - likeness(words(t), words(edited))) < 0.2
        assert abs(out[i].near_next - likeness(words(t), words(following))) < 0.2
    same = {t: {out[i].fingerprint for i in ids if documents[i] == t} for t in documents.values()}
    assert all(len(f) == 1 for f in same.values())


def test_secret_query_counts_what_it_finds(spark, documents):
    import json

    for r in QUERIES["op10_secret_scans"](spark, SF).collect():
        found, text = json.loads(r.findings), documents[r.doc_id]
        assert r.n_candidates == len(found) and r.n_secrets == sum(f["is_secret"] for f in found)
        redacted, at = "", 0
        for f in found:
            value = text[f["start"] : f["start"] + f["chars"]]
            assert hashlib.sha256(value.encode()).hexdigest() == f["value_sha256"]
            redacted += text[at : f["start"]] + ("[REDACTED]" if f["is_secret"] else value)
            at = f["start"] + f["chars"]
        assert r.redacted_sha256 == hashlib.sha256((redacted + text[at:]).encode()).hexdigest()


def test_pipeline_against_its_stages_by_brute_force(spark, documents):
    import corpus_pipeline

    rows, at = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF).cache()
        if name == "toxicity":
            kept = {r.doc_id: r.text for r in at.collect()}
            assert len(kept) == at.count() and set(kept.items()) <= set((r.doc_id, r.text) for r in before.collect())
        if name == "minhash_near_dedup":
            shingles = {}
            for i, t in kept.items():
                w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
                shingles[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            root = {i: i for i in kept}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i in kept:
                for j in kept:
                    if i < j and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]) > 0:
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
            assert {r.doc_id for r in at.collect()} == {i for i in kept if find(i) == i}
        if name == "mixing":
            sizes = Counter(r.doc_id for r in at.collect())
            assert max(sizes.values()) <= 3
            rows = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in at.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in at.collect()) == rows
    assert sorted((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == rows
