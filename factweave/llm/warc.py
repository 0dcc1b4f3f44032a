"""WARC archives: a writer that records repeated payloads as revisits, and a reader that splits files at any byte."""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint_root, materialise

#: Shorter payloads are always stored in full.
MIN_REVISIT_BYTES = 100
SPLIT_BYTES = 16 << 20
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
SALTS = 16
CAPTURED = "1970-01-01T00:00:00Z"

MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, bytes long, records long"
RECORD = ("path string, offset long, bytes long, warc_type string, record_id string, target_uri string, refers_to string, "
          "payload_digest string, payload_bytes long, stored_bytes long, damaged boolean")


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, first): `first` is the smallest page_id with an equal payload, if that is another page.

    Payloads below `min_bytes` have none. Only digests that repeat are looked up, and each is dealt over `SALTS` tasks, so a
    payload that a third of all pages share does not meet in one. A null html is an empty payload. Rows that repeat the
    smallest page_id all count as first; null ids are never first unless no page with the payload has an id.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= min_bytes
    firsts = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    first = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    return salted.join(firsts, ["digest", "_salt"], "left").select("page_id", "url", "payload", "digest", first.alias("first"))


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha256:{digest}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, captured: str = CAPTURED) -> bytes:
    """One record as one gzip member. A revisit keeps the headers of the response, with its length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id, digest)}",
            f"WARC-Date: {captured}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(first, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) and return the manifest (path, bytes, records).

    `folder` is in a store that all executors share; by default one below spark.checkpoint.dir. A task writes files of its own
    names, and Spark commits the manifest, so files of a repeated or lost task are listed by nobody.
    """
    folder = folder or f"{checkpoint_root(pages.sparkSession)}/factweave/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink, name, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if sink is None:
                    name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = member(*row)
                sink.write(raw)
                size, records = size + len(raw), records + 1
                if size >= file_bytes:
                    sink.close()
                    sink = None
                    done.append((f"{folder}/{name}", size, records))
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", size, records))
        if done:
            paths, sizes, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"])

    return materialise(mark_revisits(pages, min_bytes).mapInArrow(write, MANIFEST), "manifest")


def _header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields of a record or HTTP head, and where its block begins."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return fields, end + 4


class _Window:
    """Reads one file forward; bytes before the wanted position are forgotten."""

    def __init__(self, source, at: int):
        self.source, self.at, self.raw = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        chunk = self.source.read(READ_BYTES)
        self.raw += chunk
        return bool(chunk)

    def skip_to(self, position: int) -> None:
        while position - self.at > len(self.raw):
            self.at, self.raw = self.at + len(self.raw), b""
            if not self.more():
                break
        cut = position - self.at
        self.raw, self.at = self.raw[cut:], position

    def find(self, limit: int) -> int | None:
        """The next position of the gzip magic before `limit`; the window then begins there."""
        while True:
            found = self.raw.find(MAGIC)
            if found >= 0:
                position = self.at + found
                self.skip_to(position)
                return position if position < limit else None
            keep = max(0, len(self.raw) - len(MAGIC) + 1)
            self.at, self.raw = self.at + keep, self.raw[keep:]
            if self.at >= limit or not self.more():
                return None

    def member(self) -> tuple[bytes, int, bool] | None:
        """Decode the member at the window's start: its bytes, its end, and whether it broke off. None if it is no record."""
        unpack, parts, used, valid = zlib.decompressobj(31), [], 0, False
        while True:
            chunk = self.raw[used : used + READ_BYTES]
            if not chunk and not self.more():
                return (b"".join(parts), self.at + len(self.raw), True) if valid else None
            chunk = chunk or self.raw[used : used + READ_BYTES]
            try:
                parts.append(unpack.decompress(chunk))
            except zlib.error:
                return (b"".join(parts), self.at + used, True) if valid else None
            used += len(chunk) - len(unpack.unused_data)
            if not valid:
                head = b"".join(parts)
                if not b"WARC/".startswith(head[:5]):
                    return None
                valid = len(head) >= 5
            if unpack.eof:
                return (b"".join(parts), self.at + used, False) if valid else None


def split_records(source, start: int, end: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(offset, bytes, decoded, damaged) of every record whose member begins in [start, end) of an open file.

    The magic is only a candidate: it may also stand inside compressed bytes, so a record counts once its beginning decodes
    to a record head. After a record the next one is looked for where its member ended.
    """
    window = _Window(source, start)
    while (offset := window.find(end)) is not None:
        got = window.member()
        if got is None:
            window.skip_to(offset + 1)
            continue
        decoded, stop, damaged = got
        yield offset, stop - offset, decoded, damaged
        window.skip_to(offset + len(MAGIC) if damaged else stop)


def describe(decoded: bytes) -> dict:
    """The fields of a record; digest and length of a payload are taken from its bytes, those of a revisit from its head."""
    parsed = _header(decoded)
    if parsed is None:
        return {"damaged": True}
    fields, start = parsed
    block = decoded[start : start + int(fields.get("content-length", "0"))]
    out = {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
           "refers_to": fields.get("warc-refers-to"), "stored_bytes": len(block), "damaged": len(block) < int(fields.get("content-length", "0"))}
    http = _header(block)
    declared = fields.get("warc-payload-digest", "").partition(":")[2] or None
    if fields.get("warc-type") == "revisit":
        length = http[0].get("content-length") if http else None
        return out | {"payload_digest": declared, "payload_bytes": int(length) if length and length.isdigit() else None}
    payload = block[http[1] :] if http and block.startswith(b"HTTP/") else block
    digest = hashlib.sha256(payload).hexdigest()
    return out | {"payload_digest": digest, "payload_bytes": len(payload), "damaged": out["damaged"] or declared not in (None, digest)}


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the gzip archives in `files` (path, bytes).

    Every split of `split_bytes` is a row that a task scans on its own and owns the records beginning inside it, however far
    they reach. A record that cannot be decoded to its end, or whose payload does not have the digest it declares, is returned
    as damaged. Files without records give no rows.
    """
    starts = F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes)))
    splits = files.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    many = max(splits.sparkSession.sparkContext.defaultParallelism, int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    splits = splits.repartition(many, "path", "start")
    names = [field.split()[0] for field in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[field.split()[1]] for field in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                store, at = pafs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(at) as source:
                    for offset, length, decoded, damaged in split_records(source, start, min(size, start + split_bytes)):
                        row = describe(decoded)
                        rows.append({"path": path, "offset": offset, "bytes": length} | row | {"damaged": damaged or row["damaged"]})
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return splits.mapInArrow(read, RECORD)


def page_of(name: Column) -> Column:
    """The page_id in a record name of `record_name`, else null."""
    number = F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(number != "", number).cast("long")
