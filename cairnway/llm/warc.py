"""Operator 8 - dictionary-compressed WARC archives.

Pages become WARC/1.1 records: ``response`` with an HTTP block, or ``revisit`` (profile identical-payload-digest) for pages
whose payload of at least 100 bytes another page with a smaller id already has.  Each task writes archives of about ``ARCHIVE_BYTES``:
the first ``SAMPLE_BYTES`` of an archive's records train a Zstandard dictionary, which goes into a leading skippable frame (magic 0x184D2A5D,
as WARC-Zstandard readers expect), and every record is a Zstandard frame of its own, so records stay addressable.
Archives lie in the folder all executors share, are written under a temporary name and renamed when whole, and are named by
task, so a repeated task replaces its own file.  The reader walks frame by frame.

Equal payloads are found by digest in a narrow aggregation (id and digest, no text); pages then meet their reference by
page id and digest, which no group of copies can make hot.

Edge cases: null html counts as empty; null url is written as about:blank; equal rows are written each; rows that share the
smallest id of a payload are all responses; rows that share a page_id but not their html are pages each; a null page_id is written as null and never refers or is referred to; an empty
table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, shared_dir, stored

MIN_REVISIT, SAMPLE_BYTES, DICT_BYTES, ARCHIVE_BYTES, SKIPPABLE = 100, 4 << 20, 64 << 10, 1 << 30, 0x184D2A5D
MANIFEST = "archive string, records long, bytes long"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to): pages whose payload a page with a smaller id has.  Narrow: no payload is shuffled."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.where(F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha2(raw, 256)).alias("digest"), F.length(raw).alias("n")).where(F.col("n") >= MIN_REVISIT)
    narrow = stored(narrow.select("page_id", "digest"), "digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    return narrow.join(first, "digest").where(F.col("page_id") != F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC record: header block, HTTP header, and the payload unless it is a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _opened(at: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(at)


def trained(sample: list[bytes]):
    """A dictionary from archived records; where they are too few to train one, their raw content serves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(at: str, records: Iterator[bytes], level: int = 6, limit: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Write records to one archive until it holds ``limit`` bytes; returns (records, bytes), (0, 0) where none is left.

    Holds SAMPLE_BYTES of records and one record at most.
    """
    import zstandard

    system, path = _opened(at)
    sample, held, count = [], 0, 0
    for r in records:
        sample.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    if not sample:
        return 0, 0
    part = f"{path}.{uuid.uuid4().hex}.part"
    dictionary = trained(sample)
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    with system.open_output_stream(part, compression=None) as out:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        size = 8 + len(packed)
        for source in (sample, records):
            for r in source:
                frame = packer.compress(r)
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if source is records and size >= limit:
                    break
    system.move(part, path)
    return count, size


def read_archive(at: str) -> Iterator[bytes]:
    """The records of one archive, frame by frame, with the dictionary of its leading frame."""
    import zstandard

    system, path = _opened(at)
    with system.open_input_stream(path, compression=None) as source:
        head = source.read(8)
        magic, size = struct.unpack("<II", head)
        if magic != SKIPPABLE:
            raise ValueError(f"{at} has no dictionary frame")
        content = zstandard.ZstdDecompressor().decompress(source.read(size))
        trained_one = content[:4] == struct.pack("<I", 0xEC30A437)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained_one else zstandard.DICT_TYPE_RAWCONTENT)
        rest = b""
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
        step, whole = unpacker.decompressobj(), []
        while True:
            chunk = rest or source.read(1 << 20)
            if not chunk:
                if whole:
                    raise ValueError(f"{at} ends within a record")
                return
            whole.append(step.decompress(chunk))
            rest = b""
            if step.eof:
                rest = step.unused_data
                yield b"".join(whole)
                step, whole = unpacker.decompressobj(), []


def parse_record(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda urn: None if "null" in urn else int(urn.rsplit(":", 1)[1].rstrip(">"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload_digest": digest, "payload_bytes": length, "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str | None = None, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``; returns the manifest (archive, records, bytes)."""
    if not folder:
        folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
        WRITTEN.append((folder, None))

    def run(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}"
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)

        def records():
            for batch in batches:
                for page_id, url, html, refers_to in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), batch["refers_to"].to_pylist(), strict=True):
                    yield record(page_id, url or "about:blank", (html or "").encode(), refers_to)

        import pyarrow as pa

        left, nth = records(), 0
        while True:
            at = f"{name}-{nth:04d}.warc.zst"
            count, size = write_archive(at, left, limit=limit)
            if not count:
                return
            nth += 1
            yield pa.RecordBatch.from_pydict({"archive": [at], "records": [count], "bytes": [size]})

    digest = F.unhex(F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))
    linked = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", digest.alias("digest")).join(revisits(pages), ["page_id", "digest"], "left")
    return stored(linked.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` lists, parsed; ``payloads=False`` leaves the payloads out."""

    def run(batches):
        for batch in batches:
            for at in batch["archive"]:
                rows, held = [], 0
                for raw in read_archive(at):
                    rows.append(parse_record(raw))
                    if not payloads:
                        rows[-1].pop("payload")
                    held += len(raw) if payloads else 200
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    # About one archive a task: a stated number of parts, which adaptive execution leaves alone.
    archives = manifest.select("archive").repartition(max(1, manifest.count()))
    return archives.mapInPandas(run, READ if payloads else READ.removesuffix(", payload binary"))
