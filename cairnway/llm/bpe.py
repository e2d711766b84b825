"""Operator 4 - byte-level BPE through a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens and numbers the distinct ones of a block (``BLOCK_CHARS`` of text): a block is a
   list of words, and each document the sequence of its words' numbers, in order of position.
2. The blocks' words are exploded and shuffled by word; a part meets all copies of a word side by side and encodes it once.
   A word has at most one row a block, so no frequent word makes a part hot.
3. Ids go back to their blocks, packed, and documents are put together by position; the documents' sequences wait in a table
   bucketed by block and are not shuffled.

Decoding joins ids with the table of token bytes, which is as small as the vocabulary.

Edge cases: null texts count as empty and have no ids; a document longer than a block is a block of its own; rows may repeat
in full, each is encoded; null doc_ids are kept; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed

BLOCK_CHARS, BUNDLE_TOKENS = 48_000_000, 1 << 18
BLOCKS = "block long, seq int, words array<string>, doc_ids array<long>, counts array<int>, numbers binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: base64 of a token's bytes and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers as byte planes under Zstandard."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def cut_into_words(docs: DataFrame, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of a block: one with its words, and bundles of documents as sequences of word numbers."""

    def run(batches):
        import regex

        find, part = regex.compile(pattern).findall, TaskContext.get().partitionId()
        schema = pa.schema([("block", pa.int64()), ("seq", pa.int32()), ("words", pa.list_(pa.string())), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("numbers", pa.binary())])
        number: dict[str, int] = {}
        ids, counts, sequences, state = [], [], [], {"block": 0, "seq": 0, "tokens": 0, "chars": 0}

        def row(words=None):
            state["seq"] += 1
            numbers = pack(np.concatenate(sequences)) if sequences else None
            columns = [[(part << 32) + state["block"]], [0 if words is not None else state["seq"]], [words], [None if words is not None else list(ids)], [None if words is not None else list(counts)], [None if words is not None else numbers]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def bundle():
            out = row()
            for held in (ids, counts, sequences):
                held.clear()
            state["tokens"] = 0
            return out

        def close():
            out = row(list(number))
            number.clear()
            state.update(block=state["block"] + 1, seq=0, chars=0)
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                words = find(text)
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                ids.append(doc_id)
                counts.append(len(words))
                sequences.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
                state["tokens"] += len(words)
                state["chars"] += len(text)
                if state["tokens"] >= BUNDLE_TOKENS:
                    yield bundle()
                if state["chars"] >= block_chars:
                    if ids:
                        yield bundle()
                    yield close()
        if ids:
            yield bundle()
        if state["chars"] or state["seq"]:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


PACKED = "block long, numbers binary, sizes binary, ids binary"


def encode_words(words: DataFrame, ranks_path: str, flush: int = 1 << 20) -> DataFrame:
    """(word, block, number) -> packed rows of a block: numbers of words, how many ids each has, and the ids.

    Rows of a word lie side by side, so each distinct word is encoded once; ``flush`` rows are held at most.
    """

    def run(batches):
        import tiktoken

        # The pattern takes a word as one piece: cutting is done, only merging is left.
        encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        last, ids, blocks, numbers, found = None, [], [], [], []

        def packed():
            block, number = np.concatenate(blocks), np.concatenate(numbers)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(sizes.sum()))
            starts = np.cumsum(sizes) - sizes
            order = np.lexsort((number, block))
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            rows = []
            for part in np.split(order, cuts):
                n = sizes[part]
                at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((int(block[part[0]]), pack(np.diff(number[part], prepend=0)), pack(n), pack(flat[at])))
            for held in (blocks, numbers, found):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "numbers", "sizes", "ids"])

        for batch in batches:
            for word in batch["word"].to_pylist():
                if word != last:
                    last, ids = word, encode(word)
                found.append(ids)
            blocks.append(batch["block"].to_numpy())
            numbers.append(batch["number"].to_numpy())
            if len(found) >= flush:
                yield packed()
        if found:
            yield packed()

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, PACKED)


def put_together(words: DataFrame, bundles: DataFrame) -> DataFrame:
    """Encoded words and bundles of one block meet in one task, and documents follow by position."""

    def run(key, known: pa.Table, held: pa.Table) -> pa.Table:
        column = lambda name: [unpack(x) for x in known[name].to_pylist()]
        at = np.concatenate([np.cumsum(x, dtype=np.int64) for x in column("numbers")]) if known.num_rows else np.zeros(0, dtype=np.int64)
        sizes = np.concatenate(column("sizes")).astype(np.int64) if known.num_rows else np.zeros(0, dtype=np.int64)
        buffer = np.concatenate(column("ids")).astype(np.int32) if known.num_rows else np.zeros(0, dtype=np.int32)
        lengths, starts = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        lengths[at], starts[at] = sizes, np.cumsum(sizes) - sizes
        doc_ids, arrays = [], []
        for row in held.sort_by("seq").to_pylist():
            counts = np.array(row["counts"], dtype=np.int64)
            numbers = unpack(row["numbers"]).astype(np.int64) if counts.sum() else np.zeros(0, dtype=np.int64)
            each = lengths[numbers]
            upto = np.concatenate([[0], np.cumsum(each)])
            ids = buffer[np.repeat(starts[numbers] - upto[:-1], each) + np.arange(upto[-1])] if len(numbers) else np.zeros(0, dtype=np.int32)
            ends = upto[np.concatenate([[0], np.cumsum(counts)])]
            doc_ids += row["doc_ids"]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
        return pa.table({"doc_id": pa.array(doc_ids, type=pa.int64()), "ids": pa.chunked_array(arrays, type=pa.list_(pa.int32()))})

    return words.groupBy("block").cogroup(bundles.groupBy("block")).applyInArrow(run, "doc_id long, ids array<int>")


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids array<int>, one row for each row."""
    blocks = bucketed(cut_into_words(docs, pattern, block_chars), "block", "blocks")
    words = blocks.where(F.col("seq") == 0).select("block", F.posexplode("words").alias("number", "word"))
    bundles = blocks.where(F.col("seq") > 0).select("block", "seq", "doc_ids", "counts", "numbers")
    return put_together(encode_words(words, ranks_path), bundles)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded`` (binary): ids joined with the table of token bytes; an unknown id is an error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches):
        ranks = read_ranks(ranks_path)
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in batches:
            ids = batch["ids"]
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            if len(flat) and (flat.min() < 0 or flat.max() >= len(table)):
                raise ValueError("an id is not in the vocabulary")  # one in a gap of it fails in the join below
            out = [b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{schema}, decoded binary")
