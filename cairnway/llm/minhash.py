"""Operator 2 - near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is hashed to a bin and a value, and a bin keeps its least (round, value).  The first T rounds
place shingles at random, the next T aim each at one fixed bin, so every coordinate is filled after at most 2 T rounds, and
a text leaves the rounds as soon as its bins are full.  Equal coordinates estimate the Jaccard likeness with the
concentration of independent samples.  ``BANDS`` bands of ``ROWS`` coordinates give candidate buckets: a pair at
likeness 0.8 misses them all with a probability below 4e-6, one at 0.85 below 3e-9.

Verification compares full sets.  Equal texts are one class from the start.  Of a bucket, every member is first compared
with its leader, the member with the most neighbours, and linked ones become components.  In buckets that then still hold
several components, what is left is found relative to the leader L, whose overlap c(x) with every member x is known by then:
x and y share at most min(c(x), c(y)) shingles inside L, so a link that needs more than that needs shared shingles outside L.
Those are few, as near copies differ from L by their edits only; shingles outside L that one component alone holds cannot be
shared across, the others make an inverted index in which each member lists its rarest ones, as many as the overlap
still needed leaves (prefix filtering).  Pairs that the overlaps inside L would allow by themselves are found by their sizes.
So a group of n near copies costs about n comparisons with its leader and a few among its outliers; no pair that could
change a component is left out.  Sets lie in a table bucketed by document, so comparing moves only the candidates' sets.

Components come from alternating large-star and small-star steps on the links, kept as tables throughout.

Edge cases: null, empty and blank texts have no shingles and no links; a text shorter than a shingle is one shingle; null
doc_ids take no part (component null); repeated rows are returned each; rows that share a doc_id but not their text are documents
each, with that id; ids from 2**63 - 2**61 on are reserved; ties are decided by the smallest doc_id; an empty table gives an empty result; other columns are
ignored by :func:`components_of` and kept by :func:`one_of_each_group`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bucketed, stored

BANDS, ROWS = 32, 5
#: Ids from here on are this module's own.
RESERVED = 2**63 - 2**61


def reserved(hashed: Column) -> Column:
    """An id above all others for a text without one of its own, from a hash of the text."""
    return F.lit(RESERVED) + F.pmod(hashed, F.lit(2**61 - 1))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; fewer words make one shingle, none make none."""
    import pyarrow.compute as pc
    import xxhash

    # Arrow's ASCII kernels lower A-Z only and split at the six white-space characters that part words here.
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    starts = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    blank = np.array([w == "" for w in coded.dictionary.to_pylist()], dtype=bool)
    codes, starts = coded.indices.to_numpy(zero_copy_only=False), starts - starts[0]
    out = []
    for first, last in zip(starts[:-1], starts[1:], strict=True):
        part = codes[first:last]
        if blank.any() and len(part):
            part = part[~blank[part]]
        n = min(k, len(part))
        if not n:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        h = known[part]
        mixed = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
        out.append(np.unique(mixed))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches of several sets, given one after another: an array of (sets, size)."""
    empty = np.uint64(2**64 - 1)
    out = np.full((len(counts), size), empty, dtype=np.uint64)
    flat, owner = out.reshape(-1), np.repeat(np.arange(len(counts)), counts)
    values = values.astype(np.uint64)
    low = np.uint64((1 << 52) - 1)
    for i in range(2 * size):
        if not len(values):
            break
        h = _mix(values + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % 2**64))
        place = ((h >> np.uint64(52)) * np.uint64(size) >> np.uint64(12)).astype(np.int64) if i < size else i - size
        np.minimum.at(flat, owner * size + place, (np.uint64(i) << np.uint64(52)) | (h & low))
        if i < 3 or i % 4 == 0 or i >= size:
            open_sets = (out == empty).any(axis=1)
            keep = open_sets[owner]
            values, owner = values[keep], owner[keep]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sketches), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sketches), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = _mix(key ^ _mix(sketches[:, b * rows + r] + np.uint64(b * rows + r)))
        keys[:, b] = key
    return keys.view(np.int64)


SETS = "node long, low long, c1 long, c2 long, n long, hashes array<long>, keys array<long>"


def _shingled(texts: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(node, low, c1, c2, text) -> with the set and the keys of its bands."""

    def run(batches):
        seen: set[int] = set()  # rows of a node lie in one part: a row repeated in full is one set
        for batch in batches:
            fresh = [not (n in seen or seen.add(n)) for n in batch["node"].to_pylist()]
            if not all(fresh):
                batch = batch.filter(pa.array(fresh))
            sets = shingle_sets(batch["text"], k)
            counts = np.array([len(s) for s in sets], dtype=np.int64)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            keys = band_keys(sketch(values, counts, bands * rows), bands, rows) if len(sets) else np.zeros((0, bands), dtype=np.int64)
            keys, some = keys[counts > 0], (counts > 0).astype(np.int64) * bands  # an empty set is in no bucket
            lists = lambda n, flat: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["low"], batch["c1"], batch["c2"], pa.array(counts), lists(counts, values.view(np.int64)), lists(some, keys.reshape(-1))], names=["node", "low", "c1", "c2", "n", "hashes", "keys"])

    return texts.select("node", "low", "c1", "c2", "text").mapInArrow(run, SETS)


def connect(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Ends when the edges are stars: no node is both a leaf and a centre, and every leaf has one centre.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def stars() -> bool:
        sides = edges.select("a", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        return sides.groupBy("a").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").isEmpty()

    while not stars():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(edges, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def leftover_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may still be linked.

    ``groups``: leader, node, n (set size), c (shingles shared with the leader), component; ``sets``: node, hashes.
    """
    need = lambda m, n: F.ceil(F.lit(percent) * (m + n) / F.lit(100.0 + percent) - 1e-9)  # noqa: E731  the least overlap of a link
    smallest = F.ceil(F.col("n") * F.lit(percent) / 100.0 - 1e-9)
    held, led = sets.select("node", "hashes"), sets.select(F.col("node").alias("leader"), F.col("hashes").alias("inside"))
    spread = groups.join(held, "node").join(led, "leader").select("leader", "node", "n", "c", "component", F.explode(F.array_except("hashes", "inside")).alias("h"))
    spread = stored(spread, "spread")
    several = spread.groupBy("leader", "h").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("leader", "h", "df")
    outside = spread.join(several, ["leader", "h"]).groupBy("leader", "node", "n", "c", "component").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("out"))
    # Overlap that has to come from outside the leader, whatever the other side is.
    wanted = F.greatest(F.lit(1), need(F.col("n"), smallest) - F.col("c"))
    outside = outside.withColumn("d", F.size("out")).withColumn("wanted", wanted).where("d >= wanted")
    index = stored(outside.select("leader", "node", "n", "c", "component", "d", F.explode(F.slice("out", 1, (F.col("d") - F.col("wanted") + 1).cast("int"))).alias("o")), "index")

    def side(df: DataFrame, x: str, *keys: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in (*keys, "o")])

    fits = lambda least: (F.col("component_a") != F.col("component_b")) & (least >= need(F.col("n_a"), F.col("n_b")))
    index = index.withColumn("h", F.col("o.h"))
    by_shingle = side(index, "a", "leader", "h").join(side(index, "b", "leader", "h"), ["leader", "h"])
    by_shingle = by_shingle.where((F.col("node_a") < F.col("node_b")) & fits(F.least("c_a", "c_b") + F.least("d_a", "d_b")))
    # Overlap inside the leader may do: one of the two is not linked with the leader, the other no larger than its share allows.
    share = F.lit(percent) * (F.col("n") + F.col("nl") - F.col("c")) > F.lit(100) * F.col("c")
    loose = groups.where(share).withColumn("top", F.floor(F.col("c") * F.lit(100.0 + percent) / percent + 1e-9) - F.col("n")).withColumn("low", smallest).where("top >= low")
    loose = side(loose.withColumn("n2", F.explode(F.sequence("low", "top"))), "a", "leader", "n2")
    by_size = loose.join(side(groups.withColumn("n2", F.col("n")), "b", "leader", "n2"), ["leader", "n2"]).where((F.col("node_a") != F.col("node_b")) & fits(F.least("c_a", "c_b")))
    pair = [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")]
    return by_shingle.select(*pair).unionByName(by_size.select(*pair)).distinct()


def classified(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> (doc_id, c1, c2), a row each, and the classes of equal texts: c1, c2, low, node, n_shingles, component.

    c1 and c2 are digests of the text, ``low`` is the smallest id of a class, ``component`` the smallest node reachable.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    c1, c2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    # Narrow: which documents have equal texts.
    narrow = stored(docs.select("doc_id", c1.alias("c1"), c2.alias("c2")), "narrow")
    classes = narrow.where(F.col("doc_id").isNotNull()).groupBy("c1", "c2").agg(F.min("doc_id").alias("low"))
    # A class is known by its smallest id; further texts with the same smallest id get one of the reserved ids.
    nth = F.row_number().over(Window.partitionBy("low").orderBy("c1", "c2"))
    classes = stored(classes.withColumn("node", F.when(nth == 1, F.col("low")).otherwise(reserved(F.col("c1")))), "classes")
    # One text of each class becomes a set; texts travel once, dealt by id, which no group makes hot.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("low"), text.alias("text"), c1.alias("t1"), c2.alias("t2"))
    # Joined by id alone (the digests are compared apart from it), texts stay where the buckets of the sets want them.
    same = F.col("t1").bitwiseXOR(F.col("c1")).bitwiseOR(F.col("t2").bitwiseXOR(F.col("c2"))) == 0
    chosen = texts.repartition(parts, "low").join(classes, "low").where(same)
    sets = bucketed(_shingled(chosen, k, bands, rows), "node", "sets")

    banded = sets.select("node", "n", F.explode("keys").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("c > 1 and lo < hi")
    members = stored(banded.join(shared.select("bucket", "c"), "bucket"), "members")

    def overlaps(pairs: DataFrame) -> DataFrame:
        """(a, b) -> with ``c``, the size of the full sets' intersection, and both sizes."""
        first = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
        both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
        return both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("c"), F.size("ha").cast("long").alias("n"), F.size("hb").cast("long").alias("nl"))

    alike = F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("n") + F.col("nl") - F.col("c"))
    # Every member meets its bucket's most central one, the one with the most neighbours over all its buckets.
    degree = members.groupBy("node").agg(F.sum("c").alias("degree"))
    leaders = members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("order"), "node")).alias("l"))
    led = stored(members.join(leaders, "bucket").select("bucket", "node", F.col("l.node").alias("leader")), "led")
    tried = stored(overlaps(led.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()), "pairs")
    labels = stored(connect(tried.where(alike).select("a", "b")), "labels")

    labelled = led.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    left_over = labelled.join(several, "bucket").select("leader", "node", "component").distinct()
    groups = left_over.where("node <> leader").join(tried.select(F.col("a").alias("node"), F.col("b").alias("leader"), "n", "nl", "c"), ["node", "leader"])
    groups = stored(groups.select("leader", "node", "n", "nl", "c", "component"), "groups")
    rest = leftover_pairs(groups, sets, percent)
    found = stored(overlaps(stored(rest, "pairs")).where(alike).select("a", "b"), "links")
    if not found.isEmpty():
        labels = stored(connect(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)), "labels")

    sized = sets.select("c1", "c2", "low", "node", F.col("n").alias("n_shingles")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # One row a class, even where a hot id's rows were dealt to several tasks.
    return narrow, stored(sized.groupBy("c1", "c2", "low", "node").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component")), "sized")


def components_of(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept: links where 100 * common >= percent * union of k-word shingles."""
    narrow, sized = classified(docs, k, percent, bands, rows)
    own = F.col("component") < RESERVED
    lowest = F.min("low").over(Window.partitionBy("component"))
    named = sized.where(own).withColumn("component_id", F.col("component")).unionByName(sized.where(~own).withColumn("component_id", lowest))
    out = narrow.join(named.select("c1", "c2", "n_shingles", "component_id"), ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near-duplicates: one row of each group stays, of the smallest id (ties: of one text).

    Rows without a doc_id take part and give way to those with one; texts without words are no group and stay, once a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    c1, c2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), reserved(c1))).withColumn("__c1", c1).withColumn("__c2", c2)
    _, classes = classified(keyed.select(F.col("__id").alias("doc_id"), "text"), k, percent)
    kept = classes.where("n_shingles > 0 and component = node").select(F.col("low").alias("__id"), F.col("c1").alias("__c1"), F.col("c2").alias("__c2"))
    blank = ~F.rlike(text, F.lit(WORD))
    one = keyed.where(~blank).join(kept, ["__id", "__c1", "__c2"], "left_semi").dropDuplicates(["__id", "__c1", "__c2"])
    return one.unionByName(keyed.where(blank)).select(*[F.col(f"`{c}`") for c in docs.columns])
