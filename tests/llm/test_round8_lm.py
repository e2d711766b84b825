"""Operator 12 learns from a table of any size as often as from a small one."""

import random

import numpy as np

from cairnway.llm import lm_scoring


def test_lm_pairs_are_looked_at_as_often_in_many_buckets(spark, monkeypatch):
    """Observations of all decisions add up to twice those of training pairs, in one bucket and in many; what is held out is not sent."""
    rnd = random.Random(11)
    docs = [(i, " ".join(f"w{rnd.randint(0, 400)}" for _ in range(80))) for i in range(80)]
    blocks = lm_scoring.cut(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 1500).localCheckpoint()
    tokens = sum(int(lm_scoring.unpack(r.pair_n).sum()) for r in blocks.collect())
    ends, *_ = lm_scoring.fixed_tables(blocks)
    leaves = np.ones(1 << lm_scoring.TOP, dtype=np.int64)
    tables = (lm_scoring.node_logits(lm_scoring.tree(leaves[None, :]))[0], lm_scoring.node_logits(lm_scoring.tree(ends.reshape(lm_scoring.ENDS, -1))))
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), [])
    for buckets in (1, 12):
        states = [lm_scoring.Mixer(48, 3).merged([r.x]) for r in lm_scoring.score_pairs(blocks, buckets, none, tables, None).collect()]
        # Gates below 32 are those of single bits: each token has TOP of them.
        assert len(states) == buckets and sum(m.hits[:32].sum() for m in states) == 2 * lm_scoring.TOP * tokens
