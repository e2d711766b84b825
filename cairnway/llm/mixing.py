"""Operator 6 - mixing sources to target weights.

Targets by capped water-filling: sources share the total by weight; a source whose share is above ``max_epochs`` times its
size is clamped there and the excess is shared again by weight, until none is above.  In closed form: with sources in order
of cap over weight, the clamped ones are the first c, for the smallest c at which the level (total left over weight left)
no longer reaches the next source's ratio.

Sampling: target over size gives whole repetitions and a fraction.  Every document is taken the whole number of times; the
fraction takes documents in the order of a seeded hash, and at the sample's end the documents that still fit, so a source
misses its target by less than a small document.  The order is cut into hash buckets of about ``BUCKET_DOCS`` documents, as
many as the documents ask for, whose sums fix where each source's sample ends; only that edge (``EDGE_DOCS`` documents and one
bucket at most) is filled one by one.  No source ever meets in one task; of a source only its buckets' sums do.

Edge cases: null or blank text has size 0; a null source is a source of its own, last in order; a source without words gets
target 0 and is taken 0 times; rows that repeat a doc_id are documents each; null doc_ids are allowed; empty tables give
empty results; other columns are kept; those named like an added one are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored, without

WEIGHTS, MAX_EPOCHS, BUCKET_DOCS, EDGE_DOCS = (5, 2, 1), 3, 1000, 2000


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number below 2**52 from the id, the text and the seed, the same wherever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 12)


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size), one row a source -> with target double.  One row a source is all that is ever sorted."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    named = named.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (heavy - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = named.withColumn("level", share).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # The level at the first source that is not clamped holds for it and for all after it.
    held = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), "source", "level"))).over(whole)["level"]
    return filled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(held, F.col("level")) * F.col("weight")).alias("target"))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The end of one source's sample: in order of the draw, documents that still fit; a last one if that comes nearer."""
    rows = rows.sort_values(["draw", "doc_id", "size"], na_position="first", ignore_index=True)
    left, extra = float(rows.left.iloc[0]), []
    for size in rows["size"]:
        fits = 0 < size <= left
        extra.append(int(fits))
        left -= size * fits
    rows["extra"] = extra
    out = rows.index[(rows.extra == 0) & (rows["size"] > 0)]
    if len(out):
        least = rows.loc[out, "size"].idxmin()
        if rows.at[least, "size"] < 2 * left:
            rows.at[least, "extra"] = 1
    return rows[["doc_id", "source", "size", "source_size", "target", "whole", "extra"]]


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17, keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies (how often the mix takes a row) and taken.

    ``keep_text=False`` returns only doc_id beside the added columns.
    """
    docs = without(docs, "size", "source_size", "target", "copies", "taken")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    # A row's own number, the same for every reader: rows that agree in id and text are interchangeable.
    narrow = stored(docs.select("doc_id", "source", size.alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw")), "sizes")
    shift = max(0, 52 - max(8, (narrow.count() // BUCKET_DOCS).bit_length()))
    narrow = narrow.withColumn("bucket", F.shiftright("draw", shift))
    sums = stored(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "buckets")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio).cast("int")).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan.withColumn("wanted", F.when(F.col("whole") >= max_epochs, F.lit(0.0)).otherwise(F.col("wanted"))), "plan")
    # A row a bucket here, a thousandth of the documents.
    run = Window.partitionBy("source").orderBy("bucket")
    upto = sums.withColumn("upto", F.sum("words").over(run)).withColumn("docs_upto", F.sum("docs").over(run))
    ends = upto.join(plan.select(F.col("source").alias("s"), "wanted"), F.col("source").eqNullSafe(F.col("s")))
    full = F.col("upto") <= F.col("wanted")
    # Sums rise with the buckets, so the full ones come first; the edge reaches from there until it holds EDGE_DOCS documents.
    ends = ends.withColumn("done", F.max(F.when(full, F.col("docs_upto"))).over(Window.partitionBy("s")))
    after = ~full & (F.col("docs_upto") - F.coalesce("done", F.lit(0)) >= EDGE_DOCS)
    ends = ends.groupBy("s").agg(F.max(F.when(full, F.col("bucket"))).alias("b"), F.max(F.when(full, F.col("upto"))).alias("u"), F.min(F.when(after, F.col("bucket"))).alias("e"))
    ends = ends.select("s", F.coalesce("b", F.lit(-1)).alias("last_full"), F.coalesce("u", F.lit(0)).alias("full_words"), F.coalesce("e", F.lit(2**53)).alias("last_edge"))
    plan = plan.join(ends, plan["source"].eqNullSafe(ends["s"]), "left").select(F.col("source").alias("plan_source"), "source_size", "target", "whole", (F.col("wanted") - F.col("full_words")).alias("left"), "last_full", "last_edge")
    plan = stored(plan, "plan")
    placed = narrow.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    placed = placed.select("doc_id", "source", "size", "draw", "source_size", "target", "whole", "left", (F.col("bucket") <= F.col("last_full")).alias("inside"), ((F.col("bucket") > F.col("last_full")) & (F.col("bucket") <= F.col("last_edge"))).alias("edge"))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")]
    sure = placed.where(~F.col("edge")).withColumn("extra", F.col("inside").cast("int"))
    edge = placed.where("edge").drop("inside", "edge").groupBy("source").applyInPandas(_fill, "doc_id long, source string, size long, source_size long, target double, whole int, extra int")
    dealt = sure.select(*columns).unionByName(edge.select(*columns)).withColumn("taken", F.col("size") * F.col("copies"))
    if not keep_text:
        return dealt.drop("source")
    # Rows that agree in doc_id, source and size may differ in copies: number both sides alike before they meet.
    key = ["doc_id", "source", "size"]
    lots = dealt.groupBy(*key, "source_size", "target").agg(F.count("*").alias("n"), F.sum("copies").alias("all_copies"))
    lots = lots.select(*[F.col(c).alias(f"__{c}") for c in key], "source_size", "target", "n", "all_copies")
    held = docs.withColumn("__size_of", size).withColumn("__text_hash", F.xxhash64("text"))
    same = [F.col("doc_id").eqNullSafe(F.col("__doc_id")), F.col("source").eqNullSafe(F.col("__source")), F.col("__size_of").eqNullSafe(F.col("__size"))]
    joined = held.join(lots, same)
    several = joined.where(F.col("n") > 1).withColumn("__i", F.row_number().over(Window.partitionBy("__doc_id", "__source", "__size").orderBy("__text_hash")))
    single = joined.where(F.col("n") == 1).withColumn("__i", F.lit(1))
    shared = F.floor(F.col("all_copies") / F.col("n")) + (F.col("__i") <= F.col("all_copies") % F.col("n")).cast("long")
    out = single.unionByName(several).withColumn("copies", shared.cast("int"))
    return out.select(*docs.columns, F.col("__size_of").alias("size"), "source_size", "target", "copies", (F.col("__size_of") * F.col("copies")).alias("taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row of :func:`mix` as often as it is taken."""
    return mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
