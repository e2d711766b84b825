"""Operator 12 - language-model scoring by online logistic context mixing.

A lower-cased text is a sequence of tokens: its words, then one end.  Each token is a sequence of binary decisions:

* is the word one that training has not seen?  Such words are spelled, eight bits a byte, a space at the end;
* a word that training knows is told by its 64-bit hash, one bit after the other.  The first TOP bits are decided singly,
  and the words that share them by a last decision, whether it is the likeliest of them after the word before, and
  otherwise by their shares of the corpus.

Every bit is predicted in several hashed contexts, each with its counts of training tokens: the bits decided so far alone,
together with the end of the word before, and together with the hash of that word (spelling: the last one to
four bytes).  Their logits are combined by weights that a gate picks (how often the context was seen, whether it was always the
same bit, the depth); the weights are learned online, batch by batch, on training tokens whose own occurrence is taken out
of the counts.  The mixed probability is refined by an adaptive map from logit to observed frequency.  A bit's cost depends on
nothing but (word before, word), so it is worked out once for each distinct pair, however often texts hold it.

Spark's work: texts are cut into blocks, a block's tokens become numbers of its distinct pairs.  Distinct words of a block go to
buckets of the hash's first bits, which count them over all training texts, distinct pairs go to buckets by the first word's
hash, which hold all that follows that word; both send what they know about a block's words and pairs back to it, as packed arrays
in the block's order, and the block adds up its texts.  Pairs of a word that a large part of the corpus has in front (``HOT`` of
all pairs) are dealt to buckets by the second word's first bits as well, with the counts above those bits sent along.  Counts cover
all training texts and grow with them; of fixed size are the tables of the first TOP bits, of word ends and of spelling.

Weights are learned from all training texts as well: in every bucket from all its pairs, in every block from its words, and then averaged.
Probabilities are rounded down to 1/128 bit.  Words are told apart by 64-bit hashes, those after one word by 40 bits.

Edge cases: a null or blank text is one end; rows without a doc_id are training texts (their crc32 is null); rows that repeat
are texts each; texts of any length are read whole; without training texts every known decision costs one bit and the base score
is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pack, unpack
from .common import bucketed, held_out, stored

BLOCK_CHARS, PAIRS, WORDS, HOT = 1 << 24, 1_500_000, 2_000_000, 0.01
#: Each decision's pairs are looked at so often to learn from them, however many there are.
LOOKS = 2
#: What buckets and blocks have learned is added up in so many groups, then in the driver.
FIT_BUCKETS = 64
TOP, ENDS, END_BITS = 16, 256, 12
SPELL_SLOTS = (256, 2048, 8192, 16384)
#: The context before the first word, and the end; no word holds a line feed or is empty.
START, END = b"\n", b""
UNIT = 128.0
#: Spark's setting: files of shuffles are deleted when the query that wrote them ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLOCKS = "block long, doc_ids binary, flags binary, sizes binary, chars binary, seq binary, pair_p binary, pair_w binary, pair_n binary, words binary, word_n binary, ends binary, n_words long, n_pairs long"
#: Bytes of a second word's hash that are sent: among words after one word they tell words with the same TOP bits apart.
TOLD = 5
#: First bits by which the pairs of a hot word may be dealt out.
HOT_BITS = 8
BACK = "block long, kind string, bucket long, counts binary, values binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
LEVEL = np.digitize(np.arange(128), [1, 2, 3, 5, 9, 17, 65]).astype(np.int32)


def squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def unsqueeze(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def level(n: np.ndarray) -> np.ndarray:
    """How often a context was seen: 0, 1, 2, 3-4, 5-8, 9-16, 17-64, more."""
    return LEVEL[np.minimum(n, 127)]


def logit(own: np.ndarray, other: np.ndarray, prior: float) -> np.ndarray:
    """Of the bit at hand, from counts of it and of its opposite."""
    return np.log((own + prior) / (other + prior)).astype(np.float32)


class Mixer:
    """Weights picked by a gate, learned online, and the map that refines what they say.

    All is told from the side of the bit at hand: ``x`` is its logit, and the opposite bit's logit is -x.
    """

    def __init__(self, gates: int, inputs: int, bins: int = 33):
        self.w, self.seen = np.full((gates, inputs), 0.4, dtype=np.float32), np.full((gates, inputs), 1e-3)
        self.hits, self.total = np.zeros((gates, bins)), np.zeros((gates, bins))
        self.at = np.linspace(-8, 8, bins)
        self.refined = None

    def dot(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return np.clip(sum(self.w[:, k][gate] * st for k, st in enumerate(inputs)), -8, 8)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.rint((x + 8) * ((len(self.at) - 1) / 16)).astype(np.int64)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, times: np.ndarray) -> None:
        """One step on a batch: the map, then the gradient of the coding cost, scaled by what the gate has seen so far."""
        gates, x = len(self.w), self.dot(inputs, gate)
        error = times / (1 + np.exp(x))
        here = np.bincount(gate * len(self.at) + self.bin(x), times, self.hits.size).reshape(self.hits.shape)
        self.hits += here
        self.total += here + here[:, ::-1]  # the opposite bit's logit is -x
        for k, st in enumerate(inputs):
            self.seen[:, k] += np.bincount(gate, times * np.square(st), gates) * 0.25
            self.w[:, k] += (np.bincount(gate, error * st, gates) / self.seen[:, k]).astype(np.float32)

    def cost(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Bits that the bit at hand costs."""
        x = self.dot(inputs, gate)
        return -np.log2(0.5 / (1 + np.exp(-x)) + 0.5 * self.refined[gate, self.bin(x)])

    def state(self) -> bytes:
        return pickle.dumps((self.w, self.seen, self.hits, self.total))

    def merged(self, states: list[bytes]) -> Mixer:
        """Weights averaged by what they were learned from, observations added up; without any, weights as at the start."""
        if states:
            w, seen, hits, total = zip(*map(pickle.loads, states), strict=True)
            self.w = (sum(a * b for a, b in zip(w, seen, strict=True)) / sum(seen)).astype(np.float32)
            self.hits, self.total = sum(hits), sum(total)
        # Observed share of ones at a logit; the logit's own probability where observations are few.
        self.refined = (self.hits + 64 / (1 + np.exp(-self.at))) / (self.total + 64)
        return self


def added_up(states: DataFrame) -> list[bytes]:
    """(k, x) of every bucket or block -> FIT_BUCKETS states at most: weights averaged by what they were learned from, observations summed."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        w, seen, hits, total = zip(*map(pickle.loads, rows.sort_values("k").x), strict=True)
        x = (sum(a * b for a, b in zip(w, seen, strict=True)) / sum(seen), sum(seen), sum(hits), sum(total))
        return pd.DataFrame({"k": [rows.k.min()], "x": [pickle.dumps(x)]})

    groups = states.groupBy(F.pmod(F.xxhash64("k"), F.lit(FIT_BUCKETS)).alias("g")).applyInPandas(add, "k long, x binary")
    return [r.x for r in sorted(groups.collect(), key=lambda r: r.k)]


# -- blocks ------------------------------------------------------------------------------------------------------------
def cut(docs: DataFrame, block_chars: int) -> DataFrame:
    """Blocks of texts: their tokens as numbers of the block's distinct pairs, and these with their counts in training."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in BLOCKS.split(", ")])

    def run(batches):
        from xxhash import xxh32_intdigest

        part, done = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, held, sizes, chars, tokens = [], [], [], [], []
        so_far = 0

        def close():
            nonlocal done, so_far
            words, seq = list(number), np.concatenate(tokens)
            length = np.array(sizes, dtype=np.int64)
            before = np.empty_like(seq)
            before[1:] = seq[:-1]
            before[np.cumsum(length) - length] = 0
            pairs, at = np.unique(before.astype(np.int64) << 32 | seq, return_inverse=True)
            learn = np.repeat(~np.array(held), length)
            row = {
                "block": (part << 32) + done,
                "doc_ids": np.array([i or 0 for i in ids], dtype=np.int64).tobytes(),
                "flags": np.array([out + 2 * (i is None) for i, out in zip(ids, held, strict=True)], dtype=np.uint8).tobytes(),
                "sizes": pack(length),
                "chars": np.array(chars, dtype=np.int64).tobytes(),
                "seq": pack(at),
                "pair_p": pack(np.diff(pairs >> 32, prepend=0)),
                "pair_w": pack(pairs & 0xFFFFFFFF),
                "pair_n": pack(np.bincount(at[learn], minlength=len(pairs))),
                "words": squeeze(b" ".join(words)),
                "word_n": pack(np.bincount(seq[learn], minlength=len(words))),
                "ends": np.fromiter((xxh32_intdigest(w[-3:]) % ENDS for w in words), dtype=np.uint8, count=len(words)).tobytes(),
                "n_words": len(words),
                "n_pairs": len(pairs),
            }
            done, so_far = done + 1, 0
            for x in (number, ids, held, sizes, chars, tokens):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[c]], type=schema.field(c).type) for c in names], schema=schema)

        for batch in batches:
            for doc_id, text, out in zip(batch["doc_id"].to_pylist(), batch["text"], batch["held"].to_pylist(), strict=True):
                if not number:
                    number[START], number[END]
                data = (text.as_py() or b"").lower()
                words = data.split()
                words.append(END)
                tokens.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
                ids.append(doc_id), held.append(out), sizes.append(len(words)), chars.append(len(data))
                so_far += len(data)
                if so_far >= block_chars:
                    yield close()
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), held_out(F.col("doc_id"), 5).alias("held"))
    return rows.mapInArrow(run, BLOCKS)


def words_of(row) -> list[bytes]:
    """START and END are the first two; the rest are words."""
    return [START, END, *unsqueeze(row.words).split()]


def hashes_of(row) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words_of(row)), dtype=np.uint64, count=row.n_words)


# -- words -------------------------------------------------------------------------------------------------------------
def count_words(blocks: DataFrame, bits: int) -> DataFrame:
    """Counts over all training texts, back in each block's order of hashes, and one row of statistics a bucket (block -1)."""

    def send(batches):
        for batch in batches:
            for row in batch.itertuples():
                hashes, n = hashes_of(row), unpack(row.word_n)
                order = np.argsort(hashes, kind="stable")
                hashes, n = hashes[order], n[order]
                bucket = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64)
                edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1)))
                yield pd.DataFrame([(int(bucket[a]), row.block, hashes[a:b].tobytes(), pack(n[a:b])) for a, b in zip(edges, [*edges[1:], len(hashes)], strict=True)], columns=["bucket", "block", "hashes", "n"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        hashes, n = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows.hashes]), np.concatenate([unpack(x) for x in rows.n])
        found, at = np.unique(hashes, return_inverse=True)
        c = np.bincount(at, n, len(found)).astype(np.int64)
        leaf = (found >> np.uint64(64 - TOP)).astype(np.int64)
        total = np.bincount(leaf, c, 1 << TOP)
        tail = np.where(c > 0, -np.log2(np.maximum(c, 1) / np.maximum(total[leaf], 1)), 0).astype(np.float32)
        bucket, used = int(rows.bucket.iloc[0]), np.flatnonzero(total)
        out = [(-1, "s", bucket, pack(used), np.array([*total[used].astype(np.int64), (c > 0).sum(), (c == 1).sum()], dtype=np.int64).tobytes())]
        start = 0
        for block, x in zip(rows.block, rows.hashes, strict=True):
            mine = at[start : start + len(x) // 8]
            out.append((block, "w", bucket, squeeze(c[mine].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()), squeeze(tail[mine].tobytes())))
            start += len(mine)
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "counts", "values"])

    sent = blocks.select("block", "words", "n_words", "word_n").mapInPandas(send, "bucket long, block long, hashes binary, n binary")
    return sent.groupBy("bucket").applyInPandas(meet, BACK)


# -- tables of fixed size -------------------------------------------------------------------------------------------------
def slots(data: np.ndarray) -> list[np.ndarray]:
    """Of each byte of words, each ended by a space: the slots of the last one, two, three and four bytes before it."""
    most = len(SPELL_SLOTS)
    before = np.concatenate([np.full(most, 32, dtype=np.int64), data])
    last, context, out = None, np.zeros(len(data), dtype=np.int64), []
    for k, size in enumerate(SPELL_SLOTS):
        byte = before[most - 1 - k : len(before) - 1 - k]
        last = byte if last is None else np.where(last == 32, 32, byte)  # nothing before the word's own beginning
        context = context << 8 | last
        out.append((context * 2654435761 >> 7) % size if k else context)
    return out


def fixed_tables(blocks: DataFrame) -> list[np.ndarray]:
    """Counts over all blocks: (end of the word before, first bits of the word), and bytes by their spelling contexts."""
    shapes = [ENDS << END_BITS, *[n * 256 for n in SPELL_SLOTS]]
    chunk = 1 << 16

    def add(batches):
        tables = [np.zeros(n, dtype=np.int64) for n in shapes]
        for batch in batches:
            for row in batch.itertuples():
                hashes, ends = hashes_of(row), np.frombuffer(row.ends, dtype=np.uint8)
                p, w, n = np.cumsum(unpack(row.pair_p).astype(np.int64)), unpack(row.pair_w), unpack(row.pair_n)
                tables[0] += np.bincount((ends[p].astype(np.int64) << END_BITS) + (hashes[w] >> np.uint64(64 - END_BITS)).astype(np.int64), n, shapes[0]).astype(np.int64)
                known = unpack(row.word_n) > 0
                data = np.frombuffer(b" ".join([w for w, k in zip(words_of(row)[2:], known[2:], strict=True) if k] + [b""]), dtype=np.uint8).astype(np.int64)
                for table, slot in zip(tables[1:], slots(data), strict=True):
                    table += np.bincount((slot << 8) + data, minlength=len(table))
        yield pd.DataFrame([(k, i, squeeze(t[i : i + chunk].tobytes())) for k, t in enumerate(tables) for i in range(0, len(t), chunk)], columns=["k", "i", "x"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.head(1).assign(x=[squeeze(sum(np.frombuffer(unsqueeze(x), dtype=np.int64) for x in rows.x).tobytes())])

    sums = blocks.select("ends", "pair_p", "pair_w", "pair_n", "words", "n_words", "word_n").mapInPandas(add, "k int, i int, x binary").groupBy("k", "i").applyInPandas(total, "k int, i int, x binary")
    out = [np.zeros(n, dtype=np.int64) for n in shapes]
    for r in sums.collect():  # a fixed number of cells
        part = np.frombuffer(unsqueeze(r.x), dtype=np.int64)
        out[r.k][r.i : r.i + len(part)] = part
    return out


def tree(leaves: np.ndarray) -> np.ndarray:
    """(rows, 2**depth) counts -> counts of all nodes in heap order, the root at 1."""
    levels = [leaves]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(leaves), -1, 2).sum(axis=2))
    return np.concatenate([np.zeros((len(leaves), 1), dtype=leaves.dtype), *levels[::-1]], axis=1)


def node_logits(nodes: np.ndarray, prior: float = 0.4) -> np.ndarray:
    """Of each node, from the side of its own bit."""
    other = nodes[:, np.arange(nodes.shape[1]) ^ 1]
    return np.clip(logit(nodes, other, prior), -8, 8)


# -- pairs -------------------------------------------------------------------------------------------------------------
class Pairs:
    """Distinct pairs of a bucket in order of (first word, second word's hash), and what their bits cost."""

    def __init__(self, p, w, n, ends, place):
        order = np.lexsort((w, p))
        p, w = p[order], w[order]
        new_p = np.concatenate([[True], p[1:] != p[:-1]])
        new = new_p | np.concatenate([[True], w[1:] != w[:-1]])
        self.at = np.empty(len(order), dtype=np.int64)
        self.at[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.c = np.add.reduceat(n[order].astype(np.int64), first)
        self.w, self.new_p, self.ends = w[first], new_p[first], ends[order][first].astype(np.int64)
        self.top = (self.w >> np.uint64(64 - TOP)).astype(np.int64)
        self.place = place[order][first]

    def groups(self, depth: int, c: np.ndarray):
        """Where the pairs begin that share the first word and ``depth`` bits of the second, and their sums."""
        bits = self.top >> (TOP - depth)
        starts = np.flatnonzero(self.new_p | np.concatenate([[True], bits[1:] != bits[:-1]]))
        return starts, np.diff(starts, append=len(c))

    def bits(self, tables, hot: list, loo: bool):
        """(inputs, gate, first rows, widths) of each decision; ``loo`` takes the pair's own occurrence out of the counts.

        Pairs that share the first word and the bits so far share a decision, which is told once, with the number of pairs.
        """
        alone, by_end = tables
        less = 1 if loo else 0
        starts, width = self.groups(0, self.c)
        n = np.repeat(np.add.reduceat(self.c, starts), width)
        for d in range(TOP):
            starts, width = self.groups(d + 1, self.c)
            m = np.repeat(np.add.reduceat(self.c, starts), width)
            for rows, depth, nodes in hot:
                if d < depth:  # above the bits by which a hot word was dealt out, its counts come along
                    child = (1 << d + 1) | (self.top[rows] >> (TOP - d - 1))
                    n[rows], m[rows] = nodes[child >> 1], nodes[child]
            all_, sure = n[starts], m[starts]
            own, other = np.maximum(sure - less, 0), all_ - sure
            child = (1 << d + 1) | (self.top[starts] >> (TOP - d - 1))
            inputs = [logit(own, other, 0.1), alone[child], by_end[self.ends[starts], child] if d < END_BITS else np.zeros(len(starts), dtype=np.float32)]
            yield inputs, level(own + other) * 2 + ((own == 0) | (other == 0)) + 16 * (d >= TOP // 2), starts, width
            n = m
        starts, width = self.groups(TOP, self.c)
        best = np.repeat(np.maximum.reduceat(self.c, starts), width)
        total = m - less
        leads = np.flatnonzero(self.c == best)
        lead = np.zeros(len(self.c), dtype=bool)
        group = np.repeat(np.arange(len(starts)), width)
        lead[leads[np.unique(group[leads], return_index=True)[1]]] = True
        best = np.where(lead, best - less, best)
        self.hit = lead & (best > 0)
        rows = np.flatnonzero((total > 0) & (best > 0))
        sign = np.where(self.hit[rows], 1.0, -1.0).astype(np.float32)
        some, all_ = best[rows], total[rows]
        zero = np.zeros(len(rows), dtype=np.float32)
        yield [sign * logit(some, np.maximum(all_ - some, 0), 0.1), sign, zero], 32 + level(all_) * 2 + (some == all_), rows, None


def deal(row, buckets: int, hot, hashes: np.ndarray | None = None):
    """Of a block: its pairs' hashes, counts, word ends, place among the hot words (-1: none) and bucket."""
    names, depths, _ = hot
    hashes, ends = hashes_of(row) if hashes is None else hashes, np.frombuffer(row.ends, dtype=np.uint8)
    p, w = np.cumsum(unpack(row.pair_p).astype(np.int64)), unpack(row.pair_w)
    hp, hw = hashes[p], hashes[w]
    bucket, place = (hp % np.uint64(buckets)).astype(np.int64), np.full(len(p), -1, dtype=np.int32)
    if len(names):
        near = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        of_word = np.where(names[near] == hashes, near, -1).astype(np.int32)
        place = of_word[p]
        rows = np.flatnonzero(place >= 0)
        bucket[rows] = (bucket[rows] + (hw[rows] >> (np.uint64(64) - depths[place[rows]])).astype(np.int64)) % buckets
    return hp, hw, unpack(row.pair_n), ends[p], place, bucket


def hot_words(blocks: DataFrame, total: int, share: float, pairs: int):
    """First words of more than ``share`` of all pairs (fewer than 2 / share words): hashes, the bits that deal each out, and
    each's counts by the second word's first HOT_BITS bits, as a tree."""

    def look(batches):
        for batch in batches:
            for row in batch.itertuples():
                often = np.bincount(np.cumsum(unpack(row.pair_p).astype(np.int64)), minlength=row.n_words)
                some = np.flatnonzero(often > share / 2 * row.n_pairs)
                yield pd.DataFrame({"h": hashes_of(row).view(np.int64)[some], "pairs": often[some]})

    found = blocks.select("words", "pair_p", "n_words", "n_pairs").mapInPandas(look, "h long, pairs long").groupBy("h").agg(F.sum("pairs").alias("pairs"))
    found = sorted(found.where(F.col("pairs") > share / 2 * total).collect(), key=lambda r: r.h % (1 << 64))
    names = np.array([r.h for r in found], dtype=np.int64).view(np.uint64)
    depths = np.array([min(HOT_BITS, max(1, (-(-r.pairs // pairs)).bit_length() + 1)) for r in found], dtype=np.uint64)
    if not found:
        return names, depths, []

    def count(batches):
        sums = np.zeros((len(names), 1 << HOT_BITS), dtype=np.int64)
        for batch in batches:
            for row in batch.itertuples():
                _, w, n, _, place, _ = deal(row, 1, (names, depths, None))
                rows = np.flatnonzero(place >= 0)
                at = (place[rows].astype(np.int64) << HOT_BITS) + (w[rows] >> np.uint64(64 - HOT_BITS)).astype(np.int64)
                sums += np.bincount(at, n[rows], sums.size).astype(np.int64).reshape(sums.shape)
        yield pd.DataFrame({"k": range(len(sums)), "n": sums.tolist()})

    sums = np.zeros((len(names), 1 << HOT_BITS), dtype=np.int64)
    parts = blocks.select("words", "n_words", "ends", "pair_p", "pair_w", "pair_n").mapInPandas(count, "k int, n array<long>")
    for r in parts.select("k", F.posexplode("n").alias("i", "n")).groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        sums[r.k, r.i] = r.n
    return names, depths, list(tree(sums))


def score_pairs(blocks: DataFrame, buckets: int, hot, tables, mixer: Mixer | None):
    """Costs of each block's pairs, or, without a mixer, what each bucket learns (k, x) from its pairs."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(tables)
    _, depths, nodes = hot

    def send(batches):
        for batch in batches:
            for row in batch.itertuples():
                p, w, n, ends, place, bucket = deal(row, buckets, hot)
                order = np.argsort(bucket, kind="stable")
                if mixer is None:  # nothing is learned from pairs that only texts held out have
                    order = order[n[order] > 0]
                if not len(order):
                    continue
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out = []
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    mine = order[a:b]
                    new = np.flatnonzero(np.diff(p[mine], prepend=p[mine][0] + np.uint64(1)))
                    told = np.ascontiguousarray(w[mine].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOLD].T).tobytes()
                    out.append((int(bucket[mine[0]]), row.block, p[mine][new].tobytes(), pack(np.diff(new, append=len(mine))), told, pack(n[mine]), ends[mine][new].tobytes(), pack(place[mine][new] + 1)))
                yield pd.DataFrame(out, columns=["bucket", "block", "p", "runs", "w", "n", "ends", "place"])

    def load(rows: pd.DataFrame):
        rows = rows.sort_values("block")
        runs = [unpack(x) for x in rows.runs]
        each = lambda column, kind: np.concatenate([np.repeat(np.frombuffer(x, dtype=kind), r) for x, r in zip(column, runs, strict=True)])
        place = np.concatenate([np.repeat(unpack(x).astype(np.int32), r) for x, r in zip(rows.place, runs, strict=True)]) - 1
        planes = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(TOLD, -1) for x in rows.w], axis=1)
        w = np.ascontiguousarray(np.pad(planes, ((0, 8 - TOLD), (0, 0))).T).view(">u8").ravel().astype(np.uint64)
        found = Pairs(each(rows.p, np.uint64), w, np.concatenate([unpack(x) for x in rows.n]), each(rows.ends, np.uint8), place)
        return rows, found, [(np.flatnonzero(found.place == k), int(depths[k]), nodes[k]) for k in np.unique(place) if k >= 0]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows, found, hot_here = load(rows)
        mine = Mixer(48, 3)
        times = found.c.astype(np.float64)
        for inputs, gate, at, width in found.bits(shared.value, hot_here, loo=True):
            t = times[at] if width is None else np.add.reduceat(times, at)
            parts = max(1, len(t) // 65536)
            for k in [*range(parts)] * LOOKS:
                mine.learn([x[k::parts] for x in inputs], gate[k::parts], t[k::parts])
        return pd.DataFrame({"k": rows.bucket.head(1), "x": [mine.state()]})

    def cost(rows: pd.DataFrame) -> pd.DataFrame:
        rows, found, hot_here = load(rows)
        bits = np.zeros(len(found.c))
        for inputs, gate, at, width in found.bits(shared.value, hot_here, loo=False):
            if width is None:
                bits[at] += mixer.cost(inputs, gate)
            else:
                bits += np.repeat(mixer.cost(inputs, gate), width)
        told = np.minimum(np.ceil(bits * UNIT), 32767).astype(np.uint16) | np.where(found.hit, 0, 1 << 15).astype(np.uint16)
        start, out = 0, []
        for block, x in zip(rows.block, rows.w, strict=True):
            mine = told[found.at[start : start + len(x) // TOLD]]
            out.append((block, "p", int(rows.bucket.iloc[0]), None, squeeze(mine.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())))
            start += len(mine)
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "counts", "values"])

    sent = blocks.select("block", "words", "n_words", "ends", "pair_p", "pair_w", "pair_n").mapInPandas(send, "bucket long, block long, p binary, runs binary, w binary, n binary, ends binary, place binary")
    if mixer is None:
        return sent.groupBy("bucket").applyInPandas(fit, "k long, x binary")
    return sent.groupBy("bucket").applyInPandas(cost, BACK)


# -- spelling ----------------------------------------------------------------------------------------------------------
class Speller:
    """Bits of words from the counts of bytes after one to four others."""

    def __init__(self, tables: list[np.ndarray], mixer: Mixer | None = None):
        self.tables, self.nodes = tables, [tree(t.reshape(-1, 256)) for t in tables]
        self.mixer = mixer or self.fresh()

    def fresh(self) -> Mixer:
        return Mixer(512, len(SPELL_SLOTS))

    def alike(self, data: np.ndarray):
        """Bytes in equal contexts are one: their slots, the bytes, how many there are, and which of them each byte is."""
        key = data
        for slot, size in zip(slots(data), SPELL_SLOTS, strict=True):
            key = key * size + slot
        key, which, times = np.unique(key, return_inverse=True, return_counts=True)
        where = []
        for size in SPELL_SLOTS[::-1]:
            key, slot = np.divmod(key, size)
            where.append(slot)
        return where[::-1], key, times, which

    def bits(self, where: list[np.ndarray], data: np.ndarray, loo: bool):
        for d in range(8):
            child = (1 << d + 1) | (data >> (7 - d))
            own = [n[s, child] - loo for n, s in zip(self.nodes, where, strict=True)]
            other = [n[s, child ^ 1] for n, s in zip(self.nodes, where, strict=True)]
            own = [np.maximum(x, 0) for x in own]
            yield [logit(a, b, 0.2) for a, b in zip(own, other, strict=True)], level(own[3] + other[3]) * 64 + level(own[2] + other[2]) * 8 + level(own[1] + other[1])

    def learn(self, data: np.ndarray) -> None:
        where, data, times, _ = self.alike(data)
        parts = max(1, len(data) // 65536)
        for k in range(parts):
            for inputs, gate in self.bits([s[k::parts] for s in where], data[k::parts], loo=True):
                self.mixer.learn(inputs, gate, times[k::parts].astype(np.float64))

    def cost(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word, its end included."""
        if not words:
            return np.zeros(0)
        data = np.frombuffer(b" ".join([*words, b""]), dtype=np.uint8).astype(np.int64)
        where, byte, _, which = self.alike(data)
        each = sum(self.mixer.cost(inputs, gate) for inputs, gate in self.bits(where, byte, loo=False))[which]
        return np.add.reduceat(each, np.concatenate([[0], np.flatnonzero(data == 32)[:-1] + 1]))


def opened(tables: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(unsqueeze(t), dtype=np.int64) for t in tables]


def fit_speller(blocks: DataFrame, tables: list[np.ndarray]) -> Speller:
    """The weights are learned on the words that a block holds once, in all blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast([squeeze(t.tobytes()) for t in tables])

    def run(batches):
        speller = None
        for batch in batches:
            for row in batch.itertuples():
                speller = speller or Speller(opened(shared.value))
                speller.mixer, n = speller.fresh(), unpack(row.word_n)
                rare = [w for w, k in zip(words_of(row)[2:], n[2:], strict=True) if k == 1]
                if rare:
                    speller.learn(np.frombuffer(b" ".join([*rare, b""]), dtype=np.uint8).astype(np.int64))
                    yield pd.DataFrame({"k": [row.block], "x": [speller.mixer.state()]})

    out = Speller(tables)
    out.mixer.merged(added_up(blocks.select("block", "words", "word_n").mapInPandas(run, "k long, x binary")))
    return out


# -- texts -------------------------------------------------------------------------------------------------------------
def again(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, known: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """What is to be added to the bits of tokens as a text goes on: its own words that training does not know may come again.

    Whether one does is a decision of its own, by the share of such words that did so far in the text; then each of them is as likely.
    """
    out, rows = np.zeros(len(tokens)), np.flatnonzero(~known[tokens])
    if not len(rows):
        return out
    text = np.repeat(np.arange(len(starts)), sizes)[rows]
    key = text.astype(np.int64) << 32 | tokens[rows]
    _, first = np.unique(key, return_index=True)
    new = np.zeros(len(rows), dtype=bool)
    new[first] = True
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    length = np.diff(begin, append=len(rows))
    so_far = np.arange(len(rows)) - np.repeat(begin, length)
    distinct = np.cumsum(new) - new
    distinct -= np.repeat(distinct[begin], length)
    p = np.where(distinct > 0, (so_far - distinct + 0.5) / (so_far + 5.0), 0.0)
    repeat = -np.log2(np.maximum(p, 1e-9) / np.maximum(distinct, 1)) - spelled[tokens[rows]]
    out[rows] = np.where(new, -np.log2(1 - p), repeat)
    return out


def add_up(blocks: DataFrame, back: DataFrame, buckets: int, hot, stats: dict, speller: Speller) -> DataFrame:
    shared, mixer = blocks.sparkSession.sparkContext.broadcast([squeeze(t.tobytes()) for t in speller.tables]), speller.mixer
    ready: list[Speller] = []  # of a task

    def run(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("bucket")
        row = next(rows.itertuples())
        hashes = hashes_of(row)
        order = np.argsort(hashes, kind="stable")
        words = got[got.kind == "w"]
        c, tail = np.empty(len(hashes), dtype=np.int64), np.empty(len(hashes))
        c[order] = np.concatenate([np.ascontiguousarray(np.frombuffer(unsqueeze(x), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel() for x in words.counts])
        tail[order] = np.concatenate([np.frombuffer(unsqueeze(x), dtype=np.float32) for x in words["values"]])
        bucket = deal(row, buckets, hot, hashes)[5]
        told = np.empty(len(bucket), dtype=np.int64)
        told[np.argsort(bucket, kind="stable")] = np.concatenate([np.ascontiguousarray(np.frombuffer(unsqueeze(x), dtype=np.uint8).reshape(2, -1).T).view("<u2").ravel() for x in got[got.kind == "p"]["values"]])
        n, v, unseen = stats["n"], stats["v"], stats["unseen"]
        known = c > 0
        word_bits = np.full(len(c), -np.log2(1 - unseen))
        new = np.flatnonzero(~known)
        all_words = words_of(row)
        new = new[new > 0]
        spelled = np.zeros(len(c))
        if not ready:
            ready.append(Speller(opened(shared.value), mixer))
        spelled[new] = ready[0].cost([all_words[i] for i in new])
        word_bits[new] = -np.log2(unseen) + spelled[new]
        w = unpack(row.pair_w)
        pair_bits = word_bits[w] + np.where(known[w], (told & 32767) / UNIT + np.where(told >> 15, tail[w], 0), 0)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        seq, sizes = unpack(row.seq), unpack(row.sizes).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        bits = np.add.reduceat(pair_bits[seq] + again(w[seq], starts, sizes, known, spelled), starts)
        size, flags = np.frombuffer(row.chars, dtype=np.int64), np.frombuffer(row.flags, dtype=np.uint8)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(np.frombuffer(row.doc_ids, dtype=np.int64).copy(), flags >= 2),
            "held_out": flags % 2 == 1,
            "n_tokens": sizes,
            "n_known": np.add.reduceat(known[w][seq].astype(np.int64), starts),
            "train_tokens": n,
            "base_score": np.add.reduceat(base[w][seq], starts),
            "score": -bits * np.log10(2.0),
            "n_bytes": size,
            "bits_per_byte": bits / np.maximum(size, 1),
        })

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(run, SCORES)


def score(docs: DataFrame, block_chars: int = BLOCK_CHARS, pairs: int = PAIRS, share: float = HOT) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    What the steps that learn have shuffled goes as each ends: pairs are shuffled twice, to learn weights and to tell costs.
    """
    spark = docs.sparkSession
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        return _score(docs, block_chars, pairs, share)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def _score(docs: DataFrame, block_chars: int, pairs: int, share: float) -> DataFrame:
    spark = docs.sparkSession
    blocks = bucketed(cut(docs, block_chars), "block", "lm_blocks")
    sums = blocks.agg(F.sum("n_words").alias("w"), F.sum("n_pairs").alias("p"), F.count("*").alias("b")).first()
    if not sums.b:
        return spark.createDataFrame([], SCORES)
    counted = stored(count_words(blocks, min(TOP, max(0, -(-sums.w // WORDS) - 1).bit_length())), "lm_words")
    leaves, stats = np.zeros(1 << TOP, dtype=np.int64), {"v": 0, "once": 0}
    for r in counted.where("block = -1").collect():  # 2**TOP counts at most in all
        numbers, used = np.frombuffer(r["values"], dtype=np.int64), unpack(r["counts"])
        leaves[used] = numbers[:-2]
        stats["v"] += int(numbers[-2])
        stats["once"] += int(numbers[-1])
    stats["n"] = int(leaves.sum())
    stats["unseen"] = (stats["once"] + 0.5) / (stats["n"] + 1.0)
    ends, *spelling = fixed_tables(blocks)
    tables = (node_logits(tree(leaves[None, :]))[0], node_logits(tree(ends.reshape(ENDS, -1))))
    speller = fit_speller(blocks, spelling)
    buckets = max(1, -(-sums.p // pairs))
    hot = hot_words(blocks, sums.p, share, pairs)
    mixer = Mixer(48, 3).merged(added_up(score_pairs(blocks, buckets, hot, tables, None)))
    back = counted.where("block >= 0").unionByName(score_pairs(blocks, buckets, hot, tables, mixer))
    return add_up(blocks, back, buckets, hot, stats, speller)
