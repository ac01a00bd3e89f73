"""WARC archives: writing pages as records, normalising whole-file gzip, indexed reading.

Pages become ``response`` and ``revisit`` records. ``write_warcs`` writes them as archives that
are one gzip stream each, as crawlers and repackers that compress whole files leave them.
``normalise_warcs`` inflates such a stream once, writes every record again as a gzip member of
its own, and puts an offset index beside the archive, so that ``read_warcs`` can fetch a record
by (offset, length) without the rest.

Scale: one row per archive goes from step to step; tasks stream records with bounded memory,
archives are cut at a size, and files are written under a private name and renamed, so a task
that runs again or twice replaces its files with equal ones. All files are in a folder which
every executor reaches, by any scheme that Arrow's file systems know (local, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.common import written

VERSION = b"WARC/1.1"
#: Bytes that are read or inflated at a time.
CHUNK = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records long, bytes long"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        lines += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", _REVISIT)]
    lines += [("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    digits = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


class RecordReader:
    """Records of an uncompressed WARC stream, of which ``feed`` hands over any pieces."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers by lower-case name, whole record) of every record that is now complete."""
        self.buffer += data
        start = 0
        while (end := self.buffer.find(b"\r\n\r\n", start)) >= 0:
            first, *lines = bytes(self.buffer[start:end]).decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            stop = end + 4 + int(headers["content-length"]) + 4
            if len(self.buffer) < stop:
                break
            yield headers, bytes(self.buffer[start:stop])
            start = stop
        del self.buffer[:start]

    def close(self) -> None:
        if self.buffer:
            raise ValueError(f"the archive ends inside a record: {len(self.buffer)} bytes are left")


def _open_folder(path: str):
    """(Arrow file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


class _Renamed:
    """A file that gets its name when it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, root = _open_folder(folder)
        self.files.create_dir(root, recursive=True)
        self.final, self.hidden = f"{root}/{name}", f"{root}/_{name}.{uuid.uuid4().hex}"
        self.stream: BinaryIO = self.files.open_output_stream(self.hidden, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def done(self) -> None:
        self.stream.close()
        self.files.move(self.hidden, self.final)


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to) per page: of equal payloads of ``min_bytes`` or more, the largest id responds.

    A null payload is an empty one. Rows that repeat the responding id are responses too; a
    null id counts as less than any other, and where no page of a payload has an id all are
    responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.encode(F.col(html_col), "utf-8"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    winners = written(keyed.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
                      .where("copies > 1").select("sha1", "winner"), "payload-winners")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return (keyed.join(winners, "sha1", "left")
            .select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("winner")).alias("refers_to")))


def write_warcs(records: DataFrame, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """Write ``classify``'s rows as archives of one gzip stream each; their manifest (path, records, bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, file, made = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for row in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], batch["revisit"]):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row[0], row[3]))
                data = record_bytes(page_id, None if pd.isna(row[1]) else row[1], bytes(row[2]), refers_to, bool(row[4]))
                if file is None:
                    file, name = _Renamed(folder, f"pages-{task:06d}-{len(made):04d}.warc.gz"), f"{folder}/pages-{task:06d}-{len(made):04d}.warc.gz"
                    gzip, records_in, plain = zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                file.write(gzip.compress(data))
                records_in, plain = records_in + 1, plain + len(data)
                if plain >= max_bytes:
                    file = _close(file, gzip, made, name, records_in)
        if file is not None:
            _close(file, gzip, made, name, records_in)
        yield pd.DataFrame(made, columns=["path", "records", "bytes"])

    # Written, so that the archives are made once and not whenever the manifest is read.
    ids = records.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return written(ids.mapInPandas(run, _MANIFEST), "archives")


def _close(file: _Renamed, gzip, made: list, name: str, records: int) -> None:
    file.write(gzip.flush())
    file.done()
    made.append((name, records, file.size))


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The plain bytes of a gzip file, a piece at a time, whether it has one member or many."""
    inner = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield inner.decompress(data, CHUNK)
            if inner.eof:
                data, inner = inner.unused_data, zlib.decompressobj(31)
            else:
                data = inner.unconsumed_tail
    while piece := inner.flush():
        yield piece


def normalise_warcs(archives: DataFrame, folder: str) -> DataFrame:
    """Every archive of the manifest as one gzip member per record, with an offset index beside it.

    The index (``.idx``) holds a JSON line for each record: its offset and length in the
    archive, type and record id. Returns the manifest of the new archives.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path in batch["path"]:
                files, inside = _open_folder(path)
                name = path.rsplit("/", 1)[-1]
                out, index, records, reader = _Renamed(folder, name), _Renamed(folder, f"{name}.idx"), 0, RecordReader()
                with files.open_input_stream(inside, compression=None) as stream:
                    for piece in inflate(stream):
                        for headers, record in reader.feed(piece):
                            gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = gzip.compress(record) + gzip.flush()
                            line = {"offset": out.size, "length": len(member), "type": headers["warc-type"], "id": headers["warc-record-id"]}
                            index.write(json.dumps(line).encode() + b"\n")
                            out.write(member)
                            records += 1
                reader.close()
                out.done()
                index.done()
                made.append((f"{folder}/{name}", records, out.size))
            yield pd.DataFrame(made, columns=["path", "records", "bytes"])

    return written(_a_task_each(archives).mapInPandas(run, _MANIFEST), "normalised")


def read_warcs(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, fetched by their index: page_id, url, payload (null for
    revisits), payload_bytes, payload_digest, record_type, refers_to, and the archive's path with
    the record's offset and length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                files, inside = _open_folder(path)
                with files.open_input_file(inside) as archive, files.open_input_stream(f"{inside}.idx", compression=None) as stream:
                    rows, size, rest = [], 0, b""
                    while data := stream.read(CHUNK):
                        *lines, rest = (rest + data).split(b"\n")
                        for line in lines:
                            entry = json.loads(line)
                            archive.seek(entry["offset"])
                            rows.append(_parsed(zlib.decompress(archive.read(entry["length"]), 31), path, entry))
                            size += len(rows[-1][2] or b"")
                            if size >= 8 * CHUNK or len(rows) >= 5000:
                                yield _frame(rows)
                                rows, size = [], 0
                    yield _frame(rows)

    return _a_task_each(archives).mapInPandas(
        run, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, path string, offset long, length long"
    ).withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def _parsed(record: bytes, path: str, entry: dict) -> tuple:
    (headers, _), = RecordReader().feed(record)
    block = record[-4 - int(headers["content-length"]):-4]
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    revisit = headers["warc-type"] == "revisit"
    ids = [_page_id(headers[x]) if x in headers else None for x in ("warc-record-id", "warc-refers-to")]
    page_id, refers_to = (None if x is None else str(x) for x in ids)
    return (page_id, headers.get("warc-target-uri"), None if revisit else payload, int(fields["content-length"]) if revisit else len(payload),
            headers["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(payload), headers["warc-type"], refers_to,
            path, entry["offset"], entry["length"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset", "length"])


def _a_task_each(archives: DataFrame) -> DataFrame:
    """The manifest dealt out anew, so that archives which one task wrote are worked on by many."""
    return archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path"))


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages as WARC archives under ``folder``, normalise them, and read them back by their index.

    One row per page, null and repeated ids and empty and null payloads included (see
    ``classify``); extra columns, whatever their names, are not looked at; an empty table makes
    no archive and an empty result.
    """
    whole = write_warcs(classify(pages, id_col, url_col, html_col, min_bytes), f"{folder}/whole")
    return read_warcs(normalise_warcs(whole, f"{folder}/members"))
