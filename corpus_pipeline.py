"""A training-data pipeline: toxicity, near-duplicates, secrets, mixing and tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as Parquet into the shared
folder and hands it to the next.  All but the last return the columns of ``documents``, ``n_chars`` brought up to date.

Edge cases, for every stage: a null text counts as empty and stays null; null doc_ids, sources and other columns are allowed;
texts of any length are read whole; rows that repeat are rows each, but for the near-duplicates' stage, which leaves one of
them; an empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.llm import bpe, minhash, mixing, queries, secrets, toxicity
from cairnway.llm.common import WRITTEN, release, small_batches, stored, table

TOXIC = 0.7
USED = ("doc_id", "text", "source")
#: Text of a block of the last stage: the executors still hold what the stages before it have left in memory.
BLOCK_CHARS = 16_000_000


def shielded(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with the columns that no operator reads renamed out of the operators' way, and the way back."""
    names = {c: c if c in USED else f"__kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC stay; without toxic labels all of them do."""
    small_batches(spark)
    plain, back = shielded(docs)
    model = toxicity.train(plain, table(spark, sf_dir, "labels"))
    return toxicity.score(plain, model).where(F.col("score") < TOXIC).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 80 %) stays: the one with the smallest id.

    Rows without a doc_id give way to rows with one; texts without words form no groups and stay.
    """
    small_batches(spark)
    plain, back = shielded(docs)
    return minhash.one_of_each_group(plain, k=5).select(*back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and ``n_chars`` follows."""
    plain, back = shielded(docs)
    out = secrets.scan(plain).withColumn("text", F.col("redacted")).select(*back)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are never taken."""
    plain, back = shielded(docs)
    return mixing.repeated(mixing.mix(plain), plain.columns).select(*back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded ids, one row for each row of the mix."""
    small_batches(spark)
    ranks, pattern = queries.tokenizer()
    decoded = bpe.decode(bpe.encode(docs, ranks, pattern, BLOCK_CHARS), ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Learned scores, a forest and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mine = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, since=mine, keep=(WRITTEN[-1][0],))  # the stage's own tables and its input
    return STAGES[-1][1](spark, docs, sf_dir)
