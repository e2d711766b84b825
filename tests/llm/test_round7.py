"""Operator 12 learns its weights from all training texts."""

import random

import numpy as np

from cairnway.llm import lm_scoring
from cairnway.llm.bpe import unpack


def test_lm_weights_are_learned_in_every_block_and_bucket(spark):
    rnd = random.Random(7)
    docs = [(i, " ".join(f"w{rnd.randint(0, 900)}" for _ in range(60))) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    blocks = lm_scoring.cut(table, 1500).localCheckpoint()
    rows = blocks.collect()
    rare = [sum(len(w) + 1 for w, k in zip(lm_scoring.words_of(r)[2:], unpack(r.word_n)[2:], strict=True) if k == 1) for r in rows]
    assert len(rows) > 8
    ends, *spelling = lm_scoring.fixed_tables(blocks)
    speller = lm_scoring.fit_speller(blocks, spelling)
    # Eight decisions a byte, each seen from both sides.
    assert speller.mixer.total.sum() == 16 * sum(rare)
    total = sum(r.n_pairs for r in rows)
    buckets = -(-total // 300)
    leaves = np.ones(1 << lm_scoring.TOP, dtype=np.int64)
    tables = (lm_scoring.node_logits(lm_scoring.tree(leaves[None, :]))[0], lm_scoring.node_logits(lm_scoring.tree(ends.reshape(lm_scoring.ENDS, -1))))
    hot = lm_scoring.hot_words(blocks, total, 0.5, 300)
    got = lm_scoring.score_pairs(blocks, buckets, hot, tables, None)
    assert buckets > 8 and sorted(r.k for r in got.collect()) == list(range(buckets))
    assert len(lm_scoring.added_up(got)) <= lm_scoring.FIT_BUCKETS
