"""WARC archives: a writer with revisit records and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.llm.common import pick, prepare, text_slices

MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_KEY = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 18
_SLICE = 4 << 20


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file that executors share (local, HDFS, object stores)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: str | None, uri: str | None, payload: bytes, digest: str, date: str,
           refers_to: str | None = None, offset: int | None = None) -> bytes:
    """One record. A revisit has the HTTP head alone; its payload is that of the record it refers to.

    ``X-Offset`` states where the record begins in its archive, by which a reader
    tells it from a record of an archive within a payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{_KEY}{'' if key is None else quote(key, safe='')}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + quote(uri, safe="".join(map(chr, range(33, 127))).replace("%", "") + "%"))
    if offset is not None:
        head.append(f"X-Offset: {offset}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_KEY}{quote(refers_to, safe='')}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields.get("content-length", 0))]
    return fields, block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block


def _member(source, at: int, out: list[bytes] | None = None) -> int:
    """End of the gzip member at ``at``, whose data must be a WARC record; ValueError if there is none."""
    inflate = zlib.decompressobj(31)
    source.seek(at)
    begun = b""
    try:
        while not inflate.eof:
            chunk = source.read(_CHUNK)
            if not chunk:
                raise ValueError(f"cut off at {at}")
            at += len(chunk)
            pending = chunk
            while pending and not inflate.eof:
                data = inflate.decompress(pending, 4 * _CHUNK)
                pending = inflate.unconsumed_tail
                if len(begun) < len(_VERSION):
                    begun += data[:len(_VERSION)]
                    if not _VERSION.startswith(begun[:len(_VERSION)]):
                        raise ValueError("no WARC record")
                if out is not None:
                    out.append(data)
                if not data and not pending:
                    break
        if len(begun) < len(_VERSION):
            raise ValueError("no WARC record")
    except zlib.error as error:
        raise ValueError(str(error)) from error
    return at - len(inflate.unused_data)


def _stated_offset(source, at: int) -> int | None:
    source.seek(at)
    head = zlib.decompressobj(31).decompress(source.read(_CHUNK), _CHUNK).partition(b"\r\n\r\n")[0]
    found = re.search(rb"\r\nX-Offset: (\d+)", head)
    return int(found[1]) if found else None


def _chain(source, at: int, stop: int, size: int) -> list[int]:
    """Starts of the members from ``at`` on that lie before ``stop``; the one after the last must be sound as well."""
    starts = []
    while at < stop:
        starts.append(at)
        at = _member(source, at)
    if starts and at < size:
        source.seek(at)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"no member at {at}")
    return starts


def record_starts(source, size: int, begin: int, stop: int) -> list[int]:
    """Starts of the records in [begin, stop) of an archive.

    Each gzip magic number in the range is a candidate; it counts if it and all
    members after it, to the end of the range, decode as WARC records. Bytes
    that only look like a member break the chain, and a record of an archive within
    a payload states another offset. A range with such candidates but no sound
    chain (as in archives run together) is settled by walking the archive from its
    start, which raises for a damaged one. Archives that state no offsets rely on
    the chain.
    """
    stop = min(stop, size)
    if begin == 0:
        return _chain(source, 0, stop, size)
    at, doubtful = begin, False
    while at < stop:
        source.seek(at)
        data = source.read(min(_CHUNK, stop - at) + len(MAGIC) - 1)
        i = data.find(MAGIC)
        while 0 <= i and at + i < stop:
            try:
                _member(source, at + i)
            except ValueError:
                pass
            else:
                try:
                    if _stated_offset(source, at + i) not in (None, at + i):
                        raise ValueError("a record of another archive")
                    return _chain(source, at + i, stop, size)
                except ValueError:
                    doubtful = True
            i = data.find(MAGIC, i + 1)
        at += _CHUNK
    if doubtful:
        return [x for x in _chain(source, 0, stop, size) if x >= begin]
    return []


def _publish(system: fs.FileSystem, part: str, final: str) -> None:
    """Give a whole archive its name; a task that runs again finds the same rows there and leaves them.

    Some file systems refuse to move onto a name that exists, others replace the file; either is right.
    """
    if not _exists(system, final):
        try:
            system.move(part, final)
            return
        except OSError:
            if not _exists(system, final):
                raise
    system.delete_file(part)


def _exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, level: int, run: str) -> Iterator[pa.RecordBatch]:
    """One archive a task, under a name of the attempt until it is whole, so that a lost task leaves no half file."""
    context = TaskContext.get()
    system, path = open_folder(folder)
    final = f"{path}/part-{run}-{context.partitionId():06d}.warc.gz"
    part = f"{path}/_attempt-{run}-{context.taskAttemptId()}"
    records, out = 0, None
    for batch in text_slices(batches, "payload", _SLICE):
        for row in batch.to_pylist():
            payload = (row["payload"] or "").encode()
            digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
            first = row["first"]
            kind = "response" if first is None or first == row["key"] else "revisit"
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(part, compression=None)
            data = record(kind, row["key"], row["uri"], payload, digest, date, first if kind == "revisit" else None, out.tell())
            out.write(deflate.compress(data) + deflate.flush())
            records += 1
    if out is not None:
        out.close()
        _publish(system, part, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([records], pa.int64())], names=["file", "records"])


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
               date: str = "2024-01-01T00:00:00Z", level: int = 6, salts: int = 32) -> int:
    """Write a record for each page to ``folder`` (a shared one); the number of records.

    Of pages with equal payloads, that with the largest id is the response and
    the others are revisits of it. The largest id of each payload is found by a
    partial aggregation of digests and joined back over ``salts`` parts of each
    digest, so copies of one page spread over tasks. A null payload is empty. A
    null id is smaller than any and stays a response if all copies have null
    ids; repeated rows of the largest id are all responses. A folder that holds
    archives already is refused; a task that runs again writes nothing twice.
    """
    spark = pages.sparkSession
    prepare(spark)
    system, path = open_folder(folder)
    present = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    if any(f.base_name.endswith(".warc.gz") for f in present):
        raise FileExistsError(f"{folder} holds archives")
    run = uuid4().hex
    rows = pick(pages, id=id_col, uri=uri_col, payload=payload_col)
    rows = rows.select("id", "uri", "payload", F.sha1(F.encode(F.coalesce("payload", F.lit("")), "UTF-8")).alias("digest"),
                       F.pmod(F.xxhash64("id", "uri"), F.lit(salts)).alias("salt"))
    first = rows.groupBy("digest").agg(F.max("id").cast("string").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    rows = rows.join(first.hint("shuffle_hash"), ["digest", "salt"], "left")
    rows = rows.select(F.col("id").cast("string").alias("key"), "uri", "payload", "digest", "first")
    done = rows.mapInArrow(lambda b: _write(b, folder, date, level, run), "file string, records long")
    return done.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def _read(batches: Iterator[pa.RecordBatch], split: int, with_payload: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
            system, name = open_folder(path)
            rows: list[tuple] = []
            held = 0
            with system.open_input_file(name) as source:
                for at in record_starts(source, size, begin, begin + split):
                    data: list[bytes] = []
                    _member(source, at, data)
                    fields, payload = parse(b"".join(data))
                    key = lambda name: unquote((fields.get(name) or "").strip("<>").removeprefix(_KEY)) or None  # noqa: B023, E731
                    kind = fields.get("warc-type")
                    stated = (fields.get("warc-payload-digest") or "").partition(":")[2] or None
                    own = kind != "revisit"
                    rows.append((key("warc-record-id"), fields.get("warc-target-uri"), kind,
                                 len(payload) if own else int(fields.get("x-payload-length", 0)),
                                 base32_sha1(payload) if own else stated, stated, key("warc-refers-to"),
                                 payload if own and with_payload else None, path, at))
                    held += len(payload)
                    if held >= 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_FIELDS = ("key string, uri string, record_type string, payload_bytes long, payload_digest string, stated_digest string, "
           "refers_to string, payload binary, file string, offset long")


def read_warc(spark: SparkSession, folder: str, *, split: int = 4 << 20, with_payload: bool = True,
              ranges_per_task: int = 64) -> DataFrame:
    """Records of the ``*.warc.gz`` archives in ``folder``, one row each.

    Archives are cut in byte ranges of ``split`` that are read independently; a
    range owns the records that start in it, see :func:`record_starts`. A task reads
    up to ``ranges_per_task`` of them one after the other, fewer where there are not
    enough to give each core of the session three tasks.
    ``payload_digest`` is computed from the payload that was read (for revisits
    the stated one is all there is); a damaged archive raises.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    ranges = files.where("length > 0").select("path", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin")).checkpoint()

    def run(batches):
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
                            for n, t in (f.split() for f in _FIELDS.split(", "))])
        return _read(batches, split, with_payload, schema)

    n = ranges.count()
    tasks = max(-(-n // ranges_per_task), min(n, 3 * spark.sparkContext.defaultParallelism), 1)
    return ranges.repartition(tasks).mapInArrow(run, _FIELDS)
