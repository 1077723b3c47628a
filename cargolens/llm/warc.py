"""WARC archives of pages: a writer with revisit records and a reader that salvages damage.

Every record is written as a gzip member of its own. The reader takes members of any number of
records and records without compression, also mixed, and checks each (gzip checksum and length,
version line, header, content length, block digest). Where a check fails it searches for the
next member or version line at which a whole record passes all checks, goes on from there, and
logs the bytes it left out. A member that fails its own checksum is left out whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import shared_folder, stored
from cargolens.llm.simple8b import opened

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
LINE = b"WARC/1."
_MARK = re.compile(re.escape(MEMBER) + b"|" + re.escape(LINE))
#: Bytes of one archive's payloads, about; and bytes read at a time.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
PAGES = (
    "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary, path string, position long"
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(
    page_id: int | None, uri: str | None, payload: bytes, payload_digest: str, first: int | None, revisit: bool
) -> bytes:
    """One record as a gzip member; a revisit holds no payload but tells of it."""
    block = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Target-URI", (uri or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if first is not None:
            head.append(("X-Refers-To-Page", str(first)))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return member(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass(frozen=True)
class Record:
    """A record that passed all checks, with the place of its first byte, or of its member's."""

    position: int
    header: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    """Bytes from ``begin`` to ``end`` of an archive that belong to no good record.

    For a whole member in which some records are good, the range is the member's.
    """

    begin: int
    end: int
    reason: str


class _Damaged(ValueError):
    pass


class _Window:
    """The bytes of a stream from the last good place on; older bytes are let go."""

    def __init__(self, source) -> None:
        self.source, self.data, self.start, self.ended = source, bytearray(), 0, False

    def fill(self) -> bool:
        more = b"" if self.ended else self.source.read(CHUNK)
        self.ended = not more
        self.data += more
        return bool(more)

    def reach(self, at: int, n: int) -> bytes:
        while len(self.data) < at + n and self.fill():
            pass
        return bytes(self.data[at : at + n])

    def find(self, mark: bytes, at: int) -> int:
        while True:
            found = self.data.find(mark, at)
            if found >= 0:
                return found
            at = max(at, len(self.data) - len(mark) + 1)
            if not self.fill():
                return -1

    def mark(self, at: int) -> int:
        """The next place of either mark."""
        while True:
            found = _MARK.search(self.data, at)
            if found:
                return found.start()
            at = max(at, len(self.data) - len(LINE) + 1)
            if not self.fill():
                return -1

    def forget(self, n: int) -> None:
        del self.data[:n]
        self.start += n


def _parse(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Header of the record that begins at ``at``, begin of its block, and block length."""
    if not data.startswith(LINE, at):
        raise _Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise _Damaged("header without end")
    header = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Damaged("header line without colon")
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = header.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise _Damaged("no content length")
    return header, end + 4, int(length)


def _checked(position: int, header: dict[str, str], block: bytes) -> Record:
    told = header.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        raise _Damaged("block differs from its digest")
    return Record(position, header, block)


def _member(window: _Window, at: int) -> tuple[list[Record], int, str]:
    """The good records in the gzip member at ``at``, its end, and why others are not good."""
    reader, out, place = zlib.decompressobj(31), bytearray(), at
    while not reader.eof:
        piece = window.reach(place, 1 << 16)
        if not piece:
            raise _Damaged("member is cut off")
        try:
            out += reader.decompress(piece)
        except zlib.error as error:
            raise _Damaged("damaged member") from error
        place += len(piece)
        if len(out) >= 7 and not out.startswith(LINE):
            raise _Damaged("no version line")
    records, reason, begin = [], "", 0
    while not begin or 0 < begin < len(out):
        try:
            header, block, length = _parse(out, begin)
            end = block + length + 4
            if out[end - 4 : end] != b"\r\n\r\n" or len(out) < end:
                raise _Damaged("record and content length differ")
            records.append(_checked(window.start + at, header, bytes(out[block : block + length])))
            begin = end
        except _Damaged as error:
            reason = reason or str(error)
            begin = out.find(LINE, begin + 1)
    if not records:
        raise _Damaged(reason)
    return records, place - len(reader.unused_data), reason


def _plain(window: _Window, at: int) -> tuple[list[Record], int, str]:
    """The uncompressed record at ``at``, and its end."""
    if window.reach(at, 7) != LINE:
        raise _Damaged("no version line")
    end = window.find(b"\r\n\r\n", at)
    if end < 0:
        raise _Damaged("header without end")
    header, begin, length = _parse(bytes(window.data[at : end + 4]))
    block = window.reach(at + begin, length + 4)
    if len(block) != length + 4 or block[-4:] != b"\r\n\r\n":
        raise _Damaged("record and content length differ")
    return [_checked(window.start + at, header, block[:-4])], at + begin + length + 4, ""


def salvage(source) -> Iterator[Record | Gap]:
    """Good records of an open archive in order, and the gaps between them.

    An empty archive gives nothing. After a failed check every later mark, of a member or of
    a record without compression, is tried by the reader that fits it until a whole record
    passes; bytes up to there are one gap with the reason of the first failure.
    """
    window, reason = _Window(source), ""
    begin = at = 0  # from the window's start: where the gap began, and the place to try
    while window.reach(at, 1):
        reader = _member if window.reach(at, len(MEMBER)) == MEMBER else _plain
        try:
            found, end, partly = reader(window, at)
        except _Damaged as error:
            reason = reason or str(error)
            at = window.mark(at + 1)
            if at < 0:
                break
            continue
        if at > begin:
            yield Gap(window.start + begin, window.start + at, reason)
        if partly:
            yield Gap(window.start + at, window.start + end, partly)
        yield from found
        window.forget(end)
        begin, at, reason = 0, 0, ""
    if window.data[begin:]:
        yield Gap(window.start + begin, window.start + len(window.data), reason)


def dedup_records(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 0) -> DataFrame:
    """Pages with SHA-1 and length of their payload, and whether they revisit another page.

    Of equal payloads of ``least`` bytes or more, the page with the smallest id is the
    response (null ids come last; of rows with equal id, the first read), and the others
    refer to it. Payloads count as equal if length and SHA-1 are.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("uri"),
        body.alias("body"),
        F.sha1(body).alias("sha"),
        F.length(body).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("read"),
    )
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "read")
    firsts = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(
        F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    firsts = firsts.where("copies > 1").select("sha", "size", "first")
    revisit = F.col("first").isNotNull() & (F.col("first") != rank)
    return rows.join(firsts, ["sha", "size"], "left").select(
        "id", "uri", "body", "size", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.col("first.id").alias("first_id")
    )


def write(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record per page; return the stored list of archives: path, records, bytes.

    A null text is an empty payload. Every archive gets a new name in every attempt, and only
    archives of attempts that Spark accepts are listed. An empty table gives no archive.
    Columns other than id, text and ``url`` are not read, whatever their names.
    """
    folder = shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, path, n, size, taken = [], None, "", 0, 0, 0
        for batch in batches:
            for page, uri, body, _, revisit, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system, place = opened(folder)
                    system.create_dir(place, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, n, size, taken = system.open_output_stream(f"{place}/{name}", compression=None), f"{folder}/{name}", 0, 0, 0
                data = record(page, uri, body, digest(body), first, revisit)
                out.write(data)
                n, size, taken = n + 1, size + len(data), taken + len(body)
                if taken >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        columns = list(zip(*done, strict=True)) or [[], [], []]
        types = (pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["path", "records", "bytes"])

    records = dedup_records(pages, id_col, text_col, least)
    return stored(records.mapInArrow(run, "path string, records long, bytes long"), "warc-list")


def _whole(value: str | None) -> int | None:
    return int(value) if value is not None else None


def _spread(archives: DataFrame) -> DataFrame:
    return archives.select("path").repartition(max(1, archives.count()), "path")


def read(archives: DataFrame) -> DataFrame:
    """Good records of the listed archives (schema ``PAGES``); revisits have a null payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.split()[1] for f in PAGES.split(", ")]
        names = [f.split()[0] for f in PAGES.split(", ")]
        arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], arrow[t]) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                rows = []
                with system.open_input_stream(place, compression=None) as source:
                    for found in salvage(source):
                        if isinstance(found, Gap):
                            continue
                        h = found.header
                        kind = h.get("warc-type")
                        rows.append(
                            (
                                _whole(h.get("x-page-id")),
                                h.get("warc-target-uri"),
                                kind,
                                _whole(h.get("x-payload-length")),
                                h.get("warc-payload-digest", "").removeprefix("sha1:"),
                                _whole(h.get("x-refers-to-page")),
                                found.block if kind == "response" else None,
                                path,
                                found.position,
                            )
                        )
                        if len(rows) == 256:
                            yield made(rows)
                            rows = []
                yield made(rows)

    return _spread(archives).mapInArrow(run, PAGES)


def gaps(archives: DataFrame) -> DataFrame:
    """The quarantined byte ranges of the listed archives: path, begin, end, reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                with system.open_input_stream(place, compression=None) as source:
                    rows = [(path, g.begin, g.end, g.reason) for g in salvage(source) if isinstance(g, Gap)]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                types = (pa.string(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "begin", "end", "reason"])

    return _spread(archives).mapInArrow(run, "path string, begin long, end long, reason string")
