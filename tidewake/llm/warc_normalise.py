"""WARC: from one gzip stream around a whole archive to one gzip member for each record.

An archive is inflated once, as a stream; each record is deflated again as a member of
its own, and its place in the new file goes into an index, so that a single record can
be read by offset. One task takes one archive; records are never held whole.

The new file is written under a temporary name in the output folder and renamed when it
is complete, so a task that is run again replaces it by the same bytes. Its index rows
are written and renamed alike by the same task, as Parquet beside it (``sidecar``).

Defined results: an archive that is many members already is taken alike; an empty
archive gives an empty file and no rows; one that is cut short or broken gives the
records before that place, and a last row whose ``problem`` says so; a record without
a Content-Length is a problem too. pages: a null html is an empty payload, a null url
has no Target-URI; repeated rows are a record each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.runtime import arrow, cut, scratch

LEVEL = 6
STEP = 1 << 20
SCHEMA = "archive string, record_no long, record_type string, record_id string, target_uri string, offset long, length long, inflated long, sha256 string, problem string"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def inflated(source):
    """Pieces of the content of one gzip stream or of several in a row."""
    data, d = source.read(STEP), zlib.decompressobj(31)
    if not data:
        return
    while data:
        out = d.decompress(data, STEP)
        if out:
            yield out
        if d.eof:
            data, d = d.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            data = data or source.read(STEP)
            if not data:
                return
        else:
            data = d.unconsumed_tail or source.read(STEP)
    while not d.eof and (out := d.decompress(b"", STEP)):
        yield out
    if not d.eof:
        raise EOFError("the stream is cut short")


def _header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return m.group(1).decode("utf-8", "replace") if m else None


def rewrite(source, sink, archive: str, level: int = LEVEL):
    """Rows of the index of archive, while sink gets its records as members."""
    offset, number, buffer = 0, 0, b""
    record = None  # (row so far, deflater, bytes left, digest, start, inflated bytes)
    pieces, ended, problem = inflated(source), False, None
    while True:
        if record is None:
            at = buffer.find(b"\r\n\r\n")
            if at >= 0:
                head = buffer[: at + 4]
                size = _header(head, b"Content-Length")
                if not head.startswith(b"WARC/") or size is None or not size.isdigit():
                    yield (archive, number, None, None, None, offset, 0, len(head), None, "no WARC header with a Content-Length")
                    return
                row = (_header(head, b"WARC-Type"), _header(head, b"WARC-Record-ID"), _header(head, b"WARC-Target-URI"))
                record = [row, zlib.compressobj(level, zlib.DEFLATED, 31), len(head) + int(size) + 4, hashlib.sha256(), offset, 0, len(head)]
            elif len(buffer) >= 5 and not buffer.startswith(b"WARC/"):  # nothing tells where the next record is
                yield (archive, number, None, None, None, offset, 0, len(buffer), None, "no WARC header with a Content-Length")
                return
        if record is not None and (buffer or record[2] == 0):
            part, buffer = buffer[: record[2]], buffer[record[2] :]
            record[2] -= len(part)
            lo, hi = record[6] - record[5], record[5] + len(part) + record[2] - 4  # payload inside this part
            record[3].update(part[max(0, lo) : max(0, min(len(part), hi - record[5]))])
            record[5] += len(part)
            out = record[1].compress(part)
            if record[2] == 0:
                out += record[1].flush()
            sink.write(out)
            offset += len(out)
            if record[2] == 0:
                yield (archive, number, *record[0], record[4], offset - record[4], record[5], record[3].hexdigest(), None)
                number, record = number + 1, None
                continue
        if ended:
            break
        try:
            buffer += next(pieces)
        except StopIteration:
            ended = True
        except (EOFError, zlib.error) as e:
            ended, problem = True, f"{type(e).__name__}: {e}"[:200]
    if record is not None:
        tail = record[1].flush()
        sink.write(tail)
        offset += len(tail)
        yield (archive, number, *record[0], record[4], offset - record[4], record[5], record[3].hexdigest(), problem or "the record is cut short")
    elif problem or buffer.strip():
        yield (archive, number, None, None, None, offset, 0, len(buffer), None, problem or "bytes after the last record")


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _batches(rows):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)


def sidecar(path: str) -> str:
    """Where the index of a normalised archive stands."""
    return f"{path}.index.parquet"


def normalise(archives: DataFrame, out_dir: str, level: int = LEVEL) -> DataFrame:
    """Rewrite the archives(path) into out_dir under their names; the index, a row a record.

    Files and their sidecars are written as the result is computed.
    """

    def run(batches):
        target_fs, folder = _open(out_dir)
        for b in batches:
            for path in b.column("path").to_pylist():
                source_fs, place = _open(path)
                name = place.rsplit("/", 1)[-1]
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with (
                    source_fs.open_input_stream(place, compression=None) as source,
                    target_fs.open_output_stream(part, compression=None) as sink,
                    target_fs.open_output_stream(f"{part}.index", compression=None) as side,
                    pq.ParquetWriter(side, pa.schema(list(zip(_NAMES, _TYPES, strict=True)))) as index,
                ):
                    for rows in _batches(rewrite(source, sink, name, level)):
                        index.write_batch(rows)
                        yield rows
                target_fs.move(part, f"{folder}/{name}")
                target_fs.move(f"{part}.index", sidecar(f"{folder}/{name}"))

    return arrow(archives.where("path is not null").select("path"), run, SCHEMA)


def pack_pages(pages: DataFrame, out_dir: str, level: int = 1) -> DataFrame:
    """Write pages(page_id, url, html) as archives of one gzip stream each; their (path, records)."""

    def run(batches):
        from pyspark import TaskContext

        target_fs, folder = _open(out_dir)
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        part, n = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
        with target_fs.open_output_stream(part, compression=None) as sink:
            for b in batches:
                for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                    body = (html or "").encode()
                    uri = f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}\r\n" if url else ""
                    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page}>\r\n{uri}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
                    sink.write(deflate.compress(head.encode() + body + b"\r\n\r\n"))
                    n += 1
            sink.write(deflate.flush())
        target_fs.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{out_dir}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return arrow(pages.select("page_id", "url", "html"), run, "path string, records long")


def pages_index(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pack pages into whole-file gzip archives in the shared folder, normalise those, and give the index with page ids."""
    work = scratch(spark, "warc")
    for d in ("in", "out"):
        place, folder = _open(f"{work}/{d}")
        place.create_dir(folder, recursive=True)
    packed = cut(pack_pages(pages, f"{work}/in"))
    index = normalise(packed.repartition(max(1, packed.count())), f"{work}/out")
    return index.select("*", F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"))


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record of a normalised archive."""
    place, folder = _open(path)
    with place.open_input_file(folder) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)
