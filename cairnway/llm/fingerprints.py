"""Operator 9 - document fingerprints by consistent weighted sampling (DataFrame functions only).

A text's weighted terms are its pairs of neighbouring words (a lone word is a term itself) with their counts w.  Sample i of a
term is gamma-based: with r and c from Gamma(2, 1) and b uniform, drawn by hashing the term with i's constant,
``t = floor(ln(w) / r + b)`` and ``a = c exp(-r (t - b + 1))``; the sample of a text is the (term, t) of the least a, and
two texts agree in it with a probability equal to the generalised Jaccard likeness of their weighted terms.

The gammas are drawn as sums of exponential numbers x, z, q: c = x + z, r = ln(1 + z / x) + q, b = q / r have just the laws
asked for, and then ``a = x exp(-r t)``.  So a term of weight one, for which t is 0, needs x alone, and x is a rising function of its
hash: its sample is the hash.  Logarithms are left to the few terms that a text repeats.

A draw is a long: 47 bits of 1 - exp(-a), then SAMPLE_BITS bits that tell (term, t).  Minima are plain aggregates that whole-stage
code generation handles.  Of the least draw the low bits are kept, so that different terms look equal with a
probability of 2**-16 a sample; a likeness is the share of equal places of two signatures.  The standard error of a likeness J is sqrt(J (1 - J) / SAMPLES), 0.044 at most.

Terms and counts are found inside a row; terms that a text and its edited text share with the same weight are drawn once for
both.  Only (row, term, count) is exploded, into an aggregation whose groups are the documents at hand, so nothing is
shuffled for a fingerprint.

Edge cases: null counts as empty; a text without words has the fingerprint "-", alike to itself and to no other; texts of any
length are sampled whole; rows are ordered by doc_id (null first), then by a digest of the text; of rows that repeat in full
each is a document, followed by the next of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SAMPLES, SAMPLE_BITS = 128, 16
#: Minima worked out by one aggregation; generated code for many more is slow.
TOGETHER = 16
#: The key of a row: its id, and two digests of its text (the first also tells a null id).
ROW = ["rid", "r1", "r2"]
BLANKS = " \t\n\x0b\x0c\r"


def bind(value: Column, f) -> Column:
    """f(value), with ``value`` evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def term_hashes(text: Column) -> Column:
    """Sorted hashes of neighbouring word pairs, one for each occurrence; a lone word is a term itself."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    pairs = lambda w: F.when(F.size(w) == 1, F.array(F.xxhash64(w[0]))).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b)))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.sort_array(bind(words, pairs)))


def weighted_terms(text: Column) -> Column:
    """struct(once array<long>, often array<struct<term long, n int>>): terms of weight one, and the others with their counts."""

    def parted(h: Column) -> Column:
        alone = lambda x, i: (x != F.coalesce(F.get(h, i - 1), F.bitwise_not(x))) & (x != F.coalesce(F.get(h, i + 1), F.bitwise_not(x)))
        return F.struct(F.filter(h, alone).alias("once"), bind(F.filter(h, lambda x, i: ~alone(x, i)), runs).alias("often"))

    def runs(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        terms = bind(starts, lambda at: F.transform(at, lambda s, j: F.struct(F.get(h, s).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(h)) - s).cast("int").alias("n"))))
        return F.when(F.size(h) > 0, terms).otherwise(F.array().cast("array<struct<term:bigint,n:int>>"))

    return bind(term_hashes(F.coalesce(text, F.lit(""))), parted)


def listed(once: Column, often: Column) -> Column:
    """array<struct<term, n>> of both."""
    return F.arrays_zip(F.concat(once, often["term"]).alias("term"), F.concat(F.array_repeat(F.lit(1), F.size(once)), often["n"]).alias("n"))


def constant(i: int) -> int:
    """A fixed signed 64-bit number for sample ``i``."""
    return int.from_bytes(hashlib.sha256(b"sample %d" % i).digest()[:8], "big", signed=True)


def draw(h: Column, n: Column) -> Column:
    """The sample of a term with hash ``h`` and weight ``n`` as a long: how small it is, then which (term, t)."""
    high, low = 63 - SAMPLE_BITS, F.lit((1 << SAMPLE_BITS) - 1)
    first = F.shiftrightunsigned(h, 1)
    unit = lambda v: (v + 0.5) * F.lit(2.0**-26)
    other = F.xxhash64(h, F.lit(1))
    x = -F.log(1.0 - (F.shiftrightunsigned(h, 1 + SAMPLE_BITS) + 0.5) * F.lit(2.0**-high))
    z, q = -F.log(unit(F.shiftrightunsigned(other, 38))), -F.log(unit(F.shiftrightunsigned(other, 12).bitwiseAND(F.lit((1 << 26) - 1))))
    r = F.log(1.0 + z / x) + q
    t = F.floor((F.log(n.cast("double")) + q) / r)
    size = F.floor(-F.expm1(-x * F.exp(-r * t)) * F.lit(2.0**high))
    # Conditions one after the other, so that nothing but the hash is worked out for the many terms of weight one.
    return F.when(n == 1, first).when(t == 0, first).otherwise(F.shiftleft(size, SAMPLE_BITS).bitwiseOR(F.xxhash64(h, t).bitwiseAND(low)))


def least_draws(terms: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """(key columns, term, n) -> key columns and ``draws``: array of longs, the least draw of each sample; null without terms.

    ``terms`` has to be dealt by (part of) its key already; rows of a key are one weighted set.
    """
    width, parts = min(samples, TOGETHER), -(-samples // TOGETHER)
    # Hashes are never null here, which spares a test a draw; `some` tells sets without terms.
    rows = terms.select(*key, F.col("term").isNotNull().cast("int").alias("some"), F.coalesce("term", F.lit(0)).alias("term"), F.coalesce("n", F.lit(1)).alias("n"), F.explode(F.array(*[F.lit(p) for p in range(parts)])).alias("part"))
    rows = rows.select(*key, "part", "some", "n", F.xxhash64("term", "part").alias("e"))
    drawn = rows.groupBy(*key, "part").agg(F.max("some").alias("some"), *[F.min(draw(F.xxhash64(F.col("e").bitwiseXOR(F.lit(constant(i)))), F.col("n"))).alias(f"d{i}") for i in range(width)])
    one = F.when(F.col("some") > 0, F.array(*[f"d{i}" for i in range(width)]))
    whole = drawn.select(*key, "part", one.alias("draws")).groupBy(*key).agg(*[F.max(F.when(F.col("part") == p, F.col("draws"))).alias(f"p{p}") for p in range(parts)])
    return whole.select(*key, F.slice(F.concat(*[f"p{p}" for p in range(parts)]), 1, samples).alias("draws"))


def lesser(a: Column, b: Column) -> Column:
    """Least draws of the union of two sets; null stands for an empty set."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: F.least(x, y)), a, b)


def signature(draws: Column) -> Column:
    """array<smallint>: of each least draw the low bits."""
    return F.transform(draws, lambda d: (d.bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)) - (1 << SAMPLE_BITS - 1)).cast("smallint"))


def fingerprint(rows: DataFrame, key: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``rows`` (key columns, text) -> key columns and ``signature``; a row is a text."""
    terms = rows.select(*key, weighted_terms(F.col(text)).alias("w")).select(*key, F.explode_outer(listed(F.col("w.once"), F.col("w.often"))).alias("t"))
    return least_draws(terms.select(*key, "t.term", "t.n"), key, samples).select(*key, signature(F.col("draws")).alias("signature"))


def shown(signature: Column) -> Column:
    """A signature as text; "-" for a text without words."""
    return F.coalesce(F.array_join(signature.cast("array<string>"), "."), F.lit("-"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an unbiased estimate of the generalised Jaccard likeness."""
    placed = lambda s: F.transform(s, lambda d, i: i * (1 << SAMPLE_BITS) + d)
    same = F.size(F.array_intersect(placed(a), placed(b))) / F.lit(float(samples))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same)


def neighbours(docs: DataFrame) -> DataFrame:
    """(ROW, n_chars) in ascending row order -> with prev, prev_chars; the last row is followed by the first.

    A range exchange orders the narrow rows; neighbours inside a part come from a window of that part, and the parts'
    ends, one row a part, from a second, tiny one.
    """
    ranged = stored(docs.repartitionByRange(*ROW).withColumn("part", F.spark_partition_id()), "ranged")
    me, here = F.struct(*ROW, "n_chars"), Window.partitionBy("part").orderBy(*ROW)
    inside = ranged.withColumn("prev", F.lag(me).over(here))
    ends = ranged.groupBy("part").agg(F.max(me).alias("last"))
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.last("last").over(all_parts)).alias("before"))
    return inside.join(ends, "part").withColumn("prev", F.coalesce("prev", "before")).drop("part", "before")


def edited_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> ROW, known, copies, text, n_chars, edited, prev; one row for rows that repeat in full.

    ``edited``: the last floor(n_chars / 2) code points replaced by the first as many of the next document.  Only that
    prefix travels to the document before; whole texts are shuffled once, by row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.col("doc_id").isNotNull()
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rid"), F.xxhash64(known, text).alias("r1"), F.xxhash64(text, F.lit(1)).alias("r2")]
    base = docs.select(*key, text.alias("text"))
    order = neighbours(base.groupBy(*ROW).agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("copies")))
    # Both uses of `base` need just its key and text, so that they share one exchange of the texts.
    base = base.join(order.select(*ROW, "copies", "prev"), ROW).dropDuplicates(ROW)
    lent = base.select("prev.rid", "prev.r1", "prev.r2", F.left("text", F.floor(F.col("prev.n_chars") / 2).cast("int")).alias("lent"))
    known = (F.col("rid") != -(2**63)) | (F.col("r1") == F.xxhash64(F.lit(True), F.col("text")))
    out = base.withColumn("n_chars", F.length("text")).withColumn("known", known).join(lent, ROW)
    return out.select(*ROW, "known", "copies", "text", "n_chars", "prev", F.concat(F.left("text", F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")), "lent").alias("edited"))


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, signature, edited_signature, next_signature; one row for each row."""
    texts = edited_texts(docs)
    # A copy that another copy follows: its own first half takes the place of its last.
    half = F.floor(F.col("n_chars") / 2).cast("int")
    doubled = F.when(F.col("copies") > 1, F.concat(F.left("text", F.col("n_chars") - half), F.left("text", half)))
    sha = lambda t: F.unhex(F.sha2(t.cast("binary"), 256))
    texts = texts.select(*ROW, F.struct("known", "copies", "n_chars", "prev", sha(F.col("edited")).alias("sha"), sha(doubled).alias("doubled_sha")).alias("about"), "text", "edited", doubled.alias("doubled"))
    texts = texts.select(*ROW, "about", weighted_terms(F.col("text")).alias("w"), weighted_terms(F.col("edited")).alias("e"), F.when(F.col("doubled").isNotNull(), weighted_terms(F.col("doubled"))).alias("d"))
    # Side 0: terms of weight one in both texts; 1 and 2: the other terms of either; 3: of the doubled text.  Side 0 takes the
    # rest of the row along.
    both, none = F.array_intersect("w.once", "e.once"), F.array().cast("array<struct<term:bigint,n:int>>")
    side = lambda k, terms: F.struct(F.lit(k).alias("side"), terms.alias("terms"), F.when(F.lit(k == 0), F.col("about")).alias("about"))
    rest = lambda v: listed(F.array_except(f"{v}.once", "both"), F.col(f"{v}.often"))
    texts = texts.withColumn("both", both)
    doubled_terms = F.when(F.col("d").isNotNull(), listed(F.col("d.once"), F.col("d.often")))
    sides = texts.select(*ROW, F.explode(F.array(side(0, listed(F.col("both"), none)), side(1, rest("w")), side(2, rest("e")), side(3, F.coalesce(doubled_terms, none)))).alias("s"))
    terms = sides.select(*ROW, F.col("s.side").alias("side"), F.col("s.about").alias("about"), F.explode_outer("s.terms").alias("t")).select(*ROW, "side", "about", "t.term", "t.n")
    drawn = least_draws(terms, [*ROW, "side", "about"], samples)
    at = lambda k: F.max(F.when(F.col("side") == k, F.col("draws")))
    wide = drawn.groupBy(*ROW).agg(F.max("about").alias("about"), *[at(k).alias(f"s{k}") for k in range(4)])
    wide = wide.select(*ROW, "about.*", signature(lesser(F.col("s0"), F.col("s1"))).alias("own"), signature(lesser(F.col("s0"), F.col("s2"))).alias("edited"), signature(F.col("s3")).alias("doubled"))
    # One exchange takes a signature to its own row and to the row before.
    mine = F.struct("known", "copies", "n_chars", "sha", "doubled_sha", "own", "edited", "doubled")
    sent = F.array(F.struct(*ROW, mine.alias("mine"), F.lit(None).cast("array<smallint>").alias("next")), F.struct("prev.rid", "prev.r1", "prev.r2", F.when(F.lit(False), mine).alias("mine"), F.col("own").alias("next")))
    met = wide.select(F.explode(sent).alias("s")).select("s.*").repartition(*ROW).groupBy(*ROW).agg(F.max("mine").alias("m"), F.max("next").alias("next"))
    # The last of equal rows is followed by the next document, the ones before it by a copy.
    met = met.select("rid", "m.*", "next", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.copies"))).alias("nth"))
    last = F.col("nth") == F.col("copies")
    pick = lambda a, b: F.when(last, F.col(a)).otherwise(F.col(b))
    return met.select(F.when(F.col("known"), F.col("rid")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex(pick("sha", "doubled_sha"))).alias("edited_sha256"), F.col("own").alias("signature"), pick("edited", "doubled").alias("edited_signature"), pick("next", "own").alias("next_signature"))
