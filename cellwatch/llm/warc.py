"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Archives are written by the executors to a folder that all of them share, through pyarrow's file systems
(local mounts, HDFS, S3, ...). Every task attempt writes files of its own, and only those that a committed manifest
names are read, so a lost executor leaves no half archive in the result. Reading goes through an archive record
by record: header and payload are read to their real ends, and a block is hashed in pieces, so that memory is bounded by a record's
header, and by its payload only where payloads are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.scratch import Scratch

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at this size.
ARCHIVE_BYTES = 16 << 20
CHUNK = 256 << 10
#: Names that no sound header holds twice; two mean that a cut record runs into the next one.
ONCE = {"warc-type", "warc-record-id", "content-length"}
PAGE_URN = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    """A header value keeps to one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; a revisit holds the HTTP header only, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{PAGE_URN}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _line("" if url is None else url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{PAGE_URN}{'' if refers_to is None else refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass")
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, gzip: bool = True, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html, ...)``; returns the manifest ``(archive, records, bytes)``.

    Of rows with equal payloads of at least ``min_bytes`` the one of the largest page_id is a response and the others
    revisit it; rows that repeat this id are responses too. A null html is an empty payload; a null id counts as the
    smallest. Payloads below ``min_bytes`` are all responses. Urls and payloads may be of any length. Other columns are ignored; an empty table gives no archive.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    latest = rows.select("page_id", "sha1").groupBy("sha1").agg(F.max("page_id").alias("latest"))
    # read again it has no partitioning of its own, so Spark can split the rows of a payload that very many pages have
    rows = rows.join(scratch.save(latest, "latest"), "sha1")
    revisit = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest"))
    rows = rows.select("page_id", "url", "payload", F.col("latest").alias("refers_to"), revisit.alias("revisit"))
    folder = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, done, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [path], "records": [done], "bytes": [size]}, schema)

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path, done, size = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' * gzip}", 0, 0
                    out = store.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                row = [batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "refers_to", "revisit")]
                data = record(*row, date)
                data = member(data) if gzip else data
                out.write(data)
                done, size = done + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    schema = pa.schema({"archive": pa.string(), "records": pa.int64(), "bytes": pa.int64()})
    return scratch.save(rows.mapInArrow(run, "archive string, records bigint, bytes bigint"), "manifest")


class Damage(Exception):
    """A check of a record failed; the message names it."""


class Record(NamedTuple):
    head: dict[str, str]
    payload_bytes: int
    payload_sha1: str
    payload: bytes | None
    http: bytes


class _Stream:
    """Bytes from an iterator of pieces, with a place to read from and one piece or so of look-ahead."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def take(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        return self.held[:n]

    def through(self, mark: bytes) -> bytes | None:
        """All up to and with a mark, None if there is none; then nothing is taken."""
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.held)
            if not self.more():
                return None
        return self.take(found + len(mark))

    def upto(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces, fewer at the end."""
        while n and (self.held or self.more()):
            piece = self.take(min(n, CHUNK))
            n -= len(piece)
            yield piece

    def skip_to(self, start: re.Pattern, longest: int) -> bool:
        """Go on to the next match, False at the end."""
        while not (found := start.search(self.held)):
            self.take(max(0, len(self.held) - longest + 1))
            if not self.more():
                self.take(len(self.held))
                return False
        self.take(found.start())
        return True


def _read(stream: _Stream, with_payload: bool) -> Record:
    """The record at a stream's place, or Damage."""
    if not VERSION_LINE.match(stream.peek(10)):
        raise Damage("no version line")
    text = stream.through(b"\r\n\r\n")
    if text is None:
        raise Damage("header without end")
    head = {}
    for line in text[:-4].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without colon")
        key = name.strip().lower().decode("latin-1")
        if key in head and key in ONCE:
            raise Damage("header name repeated")
        head[key] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damage("no content length")
    whole, body, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
    revisit = head.get("warc-type") == "revisit"
    http, split = b"", False  # the HTTP header is kept for revisits, else only what may begin its end
    got = 0
    for piece in stream.upto(int(length)):
        got += len(piece)
        whole.update(piece)
        if not split:
            http += piece
            if (end := http.find(b"\r\n\r\n")) < 0:
                http = http if revisit else http[-3:]
                continue
            split, piece, http = True, http[end + 4 :], http[:end]
        body.update(piece)
        size += len(piece)
        if with_payload and not revisit:
            kept.append(piece)
    if got < int(length) or stream.peek(4) != b"\r\n\r\n":
        raise Damage("record without end")
    stream.take(4)
    named = head.get("warc-block-digest")
    if named and named != f"sha1:{base64.b32encode(whole.digest()).decode()}":
        raise Damage("block digest differs")
    return Record(head, size, base64.b32encode(body.digest()).decode(), b"".join(kept) if with_payload and not revisit else None, http)


def _file_pieces(source, at: int) -> Iterator[bytes]:
    while True:
        source.seek(at)
        chunk = source.read(CHUNK)
        if not chunk:
            return
        at += len(chunk)
        yield chunk


class _Member:
    """The inflated pieces of the gzip member at a place of a file; ``end`` is known once they are read. Damage if it is none, or is cut."""

    def __init__(self, source, at: int) -> None:
        self.source, self.at, self.end = source, at, None

    def pieces(self) -> Iterator[bytes]:
        z, at = zlib.decompressobj(31), self.at
        try:
            for chunk in _file_pieces(self.source, at):
                at += len(chunk)
                while chunk and not z.eof:
                    piece = z.decompress(chunk, 4 * CHUNK)
                    chunk = z.unconsumed_tail
                    if piece:
                        yield piece
                if z.eof:
                    self.end = at - len(z.unused_data)
                    return
        except zlib.error as e:
            raise Damage("gzip check failed") from e
        raise Damage("gzip member without end")


_START = re.compile(re.escape(GZIP_MAGIC) + rb"|WARC/1\.[01]\r\n")


def _next_start(source, at: int) -> int | None:
    """The next place from ``at`` that looks like a member or a version line."""
    stream = _Stream(_file_pieces(source, at))
    return at + stream.at if stream.skip_to(_START, 10) else None


def _of_member(source, at: int, with_payload: bool) -> Iterator[tuple[int | None, Record | None, str | None]]:
    """``(end, record, None)`` of the sound records in a gzip member and ``(end, None, reason)`` of its gaps, the end None as long as it isn't known.

    Of a member that fails its own check only records with a block digest are sound; the others wait for its end.
    """
    member, waiting, last = _Member(source, at), [], None
    stream = _Stream(member.pieces())
    try:
        while stream.peek(1):
            if last:
                yield None, last, None
                last = None
            began = stream.at
            try:
                one = _read(stream, with_payload)
            except Damage as e:
                if not stream.held and member.end is None:
                    raise
                # what was read of the failed record is gone, so its own payload is not searched
                stream.skip_to(VERSION_LINE, 10)
                yield None, None, f"{e}, bytes {began} to {stream.at} of the inflated member"
                continue
            if one.head.get("warc-block-digest"):
                last = one
            else:
                waiting.append(one)
    except Damage as e:
        if last:
            yield None, last, None
        yield None, None, str(e)
        return
    if last:
        yield member.end, last, None
    for one in waiting:
        yield member.end, one, None
    yield member.end, None, None


def salvage(source, size: int, with_payload: bool = True) -> Iterator[tuple[int, int, Record | None, str | None]]:
    """``(start, end, record, None)`` for every sound record and ``(start, end, None, reason)`` for every byte gap, in order.

    After a failed check the search goes on at the next member or version line behind the failed start. A gap
    reaches up to the next sound record, and names the first failed check. Records that a damaged record's own
    payload quotes in full are recovered as records. A gzip member of several records is searched within: its sound
    records are recovered, and a gap inside it tells the inflated bytes; only the last of them has the member's range, the others end where the member starts.
    """
    at, gap, why = 0, None, ""
    while at is not None and at < size:
        source.seek(at)
        lead = source.read(3)
        try:
            if lead == GZIP_MAGIC:
                end = None
                for end, one, failed in _of_member(source, at, with_payload):
                    if failed and ", bytes " not in failed:
                        raise Damage(failed)
                    if failed or one:
                        if gap is not None:
                            yield gap, at, None, why
                            gap = None
                        yield at, at if end is None else end, one, failed
                at = end
                continue
            stream = _Stream(_file_pieces(source, at))
            one = _read(stream, with_payload)
        except Damage as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            at = _next_start(source, at + 1)
            continue
        if gap is not None:
            yield gap, at, None, why
            gap = None
        yield at, at + stream.at, one, None
        at += stream.at
    if gap is not None:
        yield gap, size, None, why


_READ = pa.schema(
    [
        ("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
_READ_DDL = "archive string, start bigint, end bigint, gap string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def _row(archive: str, start: int, end: int, got: Record | None, why: str | None) -> dict:
    if got is None:
        return {"archive": archive, "start": start, "end": end, "gap": why}
    h = got.head
    revisit = h.get("warc-type") == "revisit"
    told = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", got.http)
    bare = lambda k: h[k].strip("<>") if k in h else None
    return {
        "archive": archive, "start": start, "end": end, "record_id": bare("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "refers_to": bare("warc-refers-to"),
        "payload_bytes": (int(told[1]) if told else None) if revisit else got.payload_bytes,
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else got.payload_sha1,
        "payload": got.payload,
    }


def read_archives(archives: DataFrame, with_payload: bool = True, whole: bool = False) -> DataFrame:
    """One row for each record and each quarantined byte gap of the files named in ``archives(archive, records, ...)``; ``records`` may be null unless ``whole``.

    A gap's row holds its bytes' range and the failed check in ``gap``, which is null for records. Payloads of
    responses are checked by their block digest; a revisit's length and digest are those that it names. An empty file
    has no rows; a missing one is an error. With ``whole``, so is a file with another number of records than its manifest's ``records``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_file(path) as source:
                    rows, held, n = [], 0, 0
                    for start, end, got, why in salvage(source, source.size(), with_payload):
                        rows.append(_row(archive, start, end, got, why))
                        n += got is not None
                        held += len(rows[-1].get("payload") or b"")
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                    if records is not None and n != records:
                        raise ValueError(f"{archive} has {n} sound records of {records}")

    files = archives.select("archive", F.col("records").cast("bigint") if whole else F.lit(None).cast("bigint").alias("records"))
    return files.repartition(max(1, min(files.count(), 20_000))).mapInArrow(run, _READ_DDL)


def archived_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every page, written and read back; page
    ids come from the records' own ids. An archive from which not all records come back is an error. The other cases are those of ``write_archives``."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, scratch)
    got = read_archives(manifest, with_payload=False, whole=True).where("gap IS NULL")
    page = lambda c: F.nullif(F.substring(c, len(PAGE_URN) + 1, 30), F.lit("")).cast("bigint")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
