"""WARC archives: a writer with revisit records and a splittable reader of gzip members.

The writer puts every record in a gzip member of its own and rolls its files; a task names its files anew at every
attempt, and only files in the manifest of successful tasks count, so lost executors leave nothing that is read.  The
reader gives tasks byte ranges of the files.  A task looks for the gzip magic, decodes the start of a candidate member
and takes it only if a WARC version line follows; it owns the records that start in its range and reads on past the
range to finish the last one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.exact import exact_groups
from pitpanel.sources.workdir import fresh_path, materialise

FILE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
REVISIT_BYTES = 1000
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, bytes long, records long"
RECORDS = "record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, payload binary, path string, offset long"


def record(kind: str, record_id: str, payload: bytes, uri: str | None, refers_to: str | None, digest: str) -> bytes:
    """One WARC record; a revisit carries the digest and length of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(rows: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows (record_id, record_type, uri, refers_to_id, payload) below ``root``; returns the manifest of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)
        out, done, size, count, path = None, [], 0, 0, ""
        for batch in batches:
            columns = [batch.column(c) for c in ("record_id", "record_type", "uri", "refers_to_id", "payload")]
            for i in range(batch.num_rows):
                rid, kind, uri, refers, payload = (c[i].as_py() for c in columns)
                payload = payload or b""
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = member(record(kind, rid, payload, uri, refers, hashlib.sha1(payload).hexdigest()))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        names = [f"{root.rstrip('/')}/{p.rsplit('/', 1)[1]}" for p, _, _ in done]
        yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "bytes": pa.array([b for _, b, _ in done], pa.int64()), "records": pa.array([n for *_, n in done], pa.int64())})

    return rows.mapInArrow(run, MANIFEST)


class Source:
    """Bytes of a file from an offset on, read in steps."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def more(self) -> bool:
        start = self.at + len(self.data)
        if start >= self.size:
            return False
        data = self.file.read_at(min(READ_BYTES, self.size - start), start)
        self.data += data
        return bool(data)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def find_member(source: Source, end: int) -> bool:
    """Move to the first valid member that starts before ``end``: gzip magic whose decoded start is a WARC version line."""
    while source.at < end:
        while len(source.data) < 4096 and source.more():
            pass
        i = source.data.find(MAGIC)
        if i < 0:
            if len(source.data) <= 2:
                return False
            source.skip(len(source.data) - 2)
            continue
        source.skip(i)
        if source.at >= end:
            return False
        while len(source.data) < 4096 and source.more():
            pass
        try:
            if zlib.decompressobj(31).decompress(source.data[:4096], len(VERSION)) == VERSION:
                return True
        except zlib.error:
            pass
        source.skip(1)
    return False


def read_member(source: Source) -> bytes | None:
    """Decode the member at the source's place and move behind it; None if it is cut or damaged."""
    z, parts, used = zlib.decompressobj(31), [], 0
    try:
        while not z.eof:
            if not source.data and not source.more():
                return None
            data = source.data
            parts.append(z.decompress(data))
            used = len(data) - len(z.unused_data)
            source.skip(used)
    except zlib.error:
        return None
    return b"".join(parts)


def parse(data: bytes) -> dict | None:
    """Fields of one record; None if it is not a whole WARC record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith(VERSION.decode()):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields.get("content-length", "-1")) if fields.get("content-length", "").isdigit() else -1
    if length < 0 or len(rest) < length:
        return None
    block, kind = rest[:length], fields.get("warc-type")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        size = int(stated[1]) if kind == "revisit" and stated else len(payload)
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
    if kind != "revisit":
        digest = hashlib.sha1(payload).hexdigest()
    bare = lambda v: v.strip("<>") if v else None
    return {"record_id": bare(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to_id": bare(fields.get("warc-refers-to")),
            "payload_bytes": size, "payload_digest": digest, "payload": None if kind == "revisit" else payload}


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the files of a manifest (path, bytes), read by byte ranges; damaged members are passed over to the next valid one."""
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("first"))
    # about one range a task, several for very many ranges
    tasks = max(1, min(ranges.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    names = RECORDS if with_payload else RECORDS.replace("payload binary, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for batch in batches:
            for path, size, first in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "first"))):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    source, end = Source(file, size, first), min(first + split_bytes, size)
                    out, held = [], 0
                    while find_member(source, end):
                        at = source.at
                        data = read_member(source)
                        found = parse(data) if data is not None else None
                        if found is None:
                            if source.at == at:
                                source.skip(1)
                            continue
                        out.append(found | {"path": path, "offset": at})
                        held += len(data)
                        if held >= 16 << 20:
                            yield batch_of(out, with_payload)
                            out, held = [], 0
                    yield batch_of(out, with_payload)

    return ranges.repartition(tasks).mapInArrow(run, names)


def batch_of(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
    names = [f.split()[0] for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names if with_payload or n != "payload"})


def page_records(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows for the writer: of equal payloads of at least ``least`` bytes the largest id is the response, the others revisit it."""
    urls = F.col(f"row.`{url}`").cast("string") if url in pages.columns else F.lit(None).cast("string")
    groups = exact_groups(pages, page_id, html)
    payload = F.coalesce(F.col(f"row.`{html}`").cast("string"), F.lit("")).cast("binary")
    again = (F.octet_length(payload) >= least) & (F.col("group_size") > 1) & ~F.col("kept")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return groups.select(name(F.col("doc_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), urls.alias("uri"),
                         F.when(again, name(F.col("keep_id"))).alias("refers_to_id"), payload.alias("payload"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null page is an empty payload, a null url leaves its field out, a null id comes back as null.  Pages that repeat an
    id with an equal payload are responses alike; an empty table writes no file and gives no rows; other columns stay out.
    """
    manifest = materialise(write_archives(page_records(pages), fresh_path(spark, "warc")), "manifest")
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    records = read_archives(manifest, with_payload=False)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))
