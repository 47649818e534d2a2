"""WARC archives written and read by Spark tasks, with a reader that survives damaged bytes."""

from __future__ import annotations

import hashlib
import logging
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import shared_folder, stored

#: Payloads below this many bytes are always written out.
MIN_REVISIT_BYTES = 100
#: A task starts a new file after this many written bytes; a file is one reading task.
FILE_BYTES = 64 * 1024 * 1024
CHUNK = 1 << 18
#: Of longer blocks the end is looked at before they are read.
LONG_BLOCK = 16 * 1024 * 1024

# fixed values of the format
VERSION = b"WARC/1.1"
VERSION_START = b"WARC/1."
GZIP_START = b"\x1f\x8b\x08"
HEAD_END = b"\r\n\r\n"
RECORD_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

log = logging.getLogger(__name__)


# ---- one record ----


def clean_value(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page: str | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None, date: str) -> bytes:
    """A ``response`` record, or a ``revisit`` without payload where ``refers_to`` names another page."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    name = page if page is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url}|{digest}").hex
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{clean_value(name)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else clean_value(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", f"<urn:page:{clean_value(refers_to)}>" if revisit else None),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("X-Page-Id", None if page is None else quote(page)),
        ("X-Page-Refers-To", None if refers_to is None else quote(refers_to)),
        ("X-Payload-Length", str(length)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """A sound record. ``offset`` is that of its gzip member or, in a plain file, its own; ``inner`` its place
    in the member's inflated bytes, null in a plain file; ``length`` its bytes there."""

    headers: dict[str, str]
    block: bytes
    offset: int = 0
    length: int = 0
    inner: int | None = None

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head; the whole block where there is none."""
        head, gap, rest = self.block.partition(b"\r\n\r\n")
        return rest if gap and head.startswith(b"HTTP/") else self.block


class Damaged(ValueError):
    """The bytes at hand aren't a sound record."""


def parse_head(head: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and the length of the block."""
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or len(size) > 18 or "warc-type" not in headers:
        raise Damaged("header fields missing")
    return headers, int(size)


# ---- windows on bytes ----


class FileWindow:
    """The bytes of a seekable file from ``base`` on, as far as they have been asked for."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.held, self.base = stream, bytearray(), 0
        self.size: int | None = stream.seek(0, 2)

    @property
    def upto(self) -> int:
        return self.base + len(self.held)

    def look(self, at: int, count: int) -> bytes:
        """Bytes at a position, without holding them."""
        self.stream.seek(at)
        return self.stream.read(count)

    def _more(self) -> None:
        self.held += self.look(self.upto, CHUNK)

    def fill(self, upto: int) -> bool:
        """Hold the bytes before ``upto``; false if the stream ends earlier."""
        while self.upto < upto and self.upto != self.size:
            self._more()
        return self.upto >= upto

    def forget(self, before: int) -> None:
        """Hold nothing before a position, which may also lie behind or before what is held."""
        if self.base <= before <= self.upto:
            del self.held[: before - self.base]
        else:
            self.held = bytearray()
        self.base = before

    def part(self, begin: int, end: int) -> bytes:
        return bytes(self.held[begin - self.base : end - self.base])

    def find(self, marks: tuple[bytes, ...], at: int) -> int:
        """The first position from ``at`` on where a mark stands, or -1; what lies before it is forgotten."""
        keep = max(map(len, marks)) - 1
        self.forget(at)
        while True:
            found = [p for p in (self.held.find(m) for m in marks) if p >= 0]
            if found:
                self.forget(self.base + min(found))
                return self.base
            self.forget(max(self.base, self.upto - keep))
            if not self.fill(self.upto + 1):
                return -1


class MemberWindow(FileWindow):
    """The inflated bytes of the gzip member that starts at a file position.

    ``raw`` is the position of the next byte to inflate. The end is reached behind the member (``whole``), where
    the file ends, or where the bytes can't be inflated; everything before a bad byte is still given out.
    """

    def __init__(self, file: FileWindow, at: int) -> None:
        self.file, self.raw, self.held, self.base = file, at, bytearray(), 0
        self.unzip = zlib.decompressobj(31)
        self.size, self.whole = None, False

    def _more(self) -> None:
        piece = self.file.look(self.raw, CHUNK)
        before = self.unzip.copy()
        try:
            out = self.unzip.decompress(piece, 4 * CHUNK)
        except zlib.error:
            self.unzip, out = before, self._upto_bad_byte(before, piece)
            self.held += out
            self.size = self.upto
            return
        self.held += out
        self.raw += len(piece) - len(self.unzip.unconsumed_tail) - len(self.unzip.unused_data)
        if self.unzip.eof or not (piece or out):
            self.size, self.whole = self.upto, self.unzip.eof

    def _upto_bad_byte(self, unzip, piece: bytes) -> bytes:
        out = bytearray()
        for i in range(len(piece)):
            try:
                out += unzip.decompress(piece[i : i + 1])
            except zlib.error:
                break
            self.raw += 1
        return bytes(out)

    def look(self, at: int, count: int) -> bytes:
        """Bytes further on, inflated without holding those in between."""
        probe = MemberWindow(self.file, self.raw)
        probe.unzip, probe.base, probe.size = self.unzip.copy(), self.upto, self.size
        while probe.upto < at + count and probe.upto != probe.size:
            probe.forget(min(at, probe.upto))
            probe._more()
        self.known = probe.size
        return probe.part(at, at + count) if probe.base <= at else b""

    #: Length of the inflated bytes if a look has met their end.
    known: int | None = None


def read_record(window: FileWindow, at: int) -> tuple[Record, int]:
    """The record that starts at a position of a window and the position behind it; raises unless every check holds.

    A length that goes beyond the end is refused, and of a long block the end is looked at before the block is held.
    """
    end = -1
    for held in (1 << 13, CHUNK):
        window.fill(at + held)
        if not window.part(at, at + len(VERSION_START)) == VERSION_START:
            raise Damaged("no version line")
        end = window.held.find(HEAD_END, at - window.base, at - window.base + CHUNK)
        if end >= 0:
            break
    if end < 0:
        raise Damaged("header without end")
    begin = window.base + end + len(HEAD_END)
    headers, size = parse_head(window.part(at, begin - len(HEAD_END)))
    stop = begin + size
    ends = [e for e in (window.size, getattr(window, "known", None)) if e is not None]
    if ends and stop + 4 > min(ends):
        raise Damaged("block goes beyond the end")
    if size > LONG_BLOCK and stop + 4 > window.upto and window.look(stop, 4) != RECORD_END:
        raise Damaged("block doesn't end where its length says")
    if not window.fill(stop + 4):
        raise Damaged("block is cut off")
    if window.part(stop, stop + 4) != RECORD_END:
        raise Damaged("block doesn't end where its length says")
    record = Record(headers, window.part(begin, stop), at, stop + 4 - at)
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha256" and headers["warc-type"] == "response" and hashlib.sha256(record.payload).hexdigest() != digest.lower():
        raise Damaged("payload digest differs")
    return record, stop + 4


# ---- a whole file ----


@dataclass
class SalvageReader:
    """Records of one archive in order: gzip members of any number of records, or plain records.

    Where a check fails, the next version line at which a sound record can be read is searched, in the inflated bytes
    inside a member, and outside also the next gzip start. ``gaps`` gets ``(offset, length)`` of the file's bytes
    given up, ``inner_gaps`` ``(member's offset, begin, length)`` of inflated bytes given up in members that gave
    other records. A member that breaks off, has a bad byte or a bad checksum keeps the records before. Memory holds one sound
    record, or ``LONG_BLOCK`` where a length is wrong, and a few chunks. The stream must be seekable.
    """

    stream: BinaryIO
    gaps: list[tuple[int, int]] = field(default_factory=list)
    inner_gaps: list[tuple[int, int, int]] = field(default_factory=list)

    def _member(self, window: MemberWindow, offset: int) -> Iterator[Record]:
        at, lost, found, gaps = 0, -1, False, []
        while at >= 0 and window.fill(at + 1):
            try:
                record, end = read_record(window, at)
            except Damaged as why:
                if lost < 0:
                    lost = at
                    log.warning("damaged record at byte %d of the member at %d: %s", at, offset, why)
                at = window.find((VERSION_START,), at + 1)
                continue
            if lost >= 0:
                gaps.append((offset, lost, at - lost))
                lost = -1
            record.offset, record.inner, found = offset, at, True
            yield record
            at = end
            window.forget(at)
        if lost >= 0:
            gaps.append((offset, lost, window.size - lost))
        if found:
            self.inner_gaps += gaps

    def __iter__(self) -> Iterator[Record]:
        file = FileWindow(self.stream)
        lost, at = -1, 0
        while at >= 0 and file.fill(at + len(GZIP_START)) or 0 <= at < file.size:
            search = at + 1
            if file.part(at, at + len(GZIP_START)) == GZIP_START:
                window, found = MemberWindow(file, at), False
                for record in self._member(window, at):
                    if lost >= 0:
                        self._quarantine(lost, at)
                        lost = -1
                    found = True
                    yield record
                if found and window.whole:
                    at = window.raw
                    file.forget(at)
                    continue
                if lost < 0:
                    lost = window.raw if found else at
                    log.warning("member at byte %d can't be read behind byte %d", at, lost)
                if found or window.whole:
                    search = window.raw
            else:
                try:
                    record, end = read_record(file, at)
                except Damaged as why:
                    if lost < 0:
                        lost = at
                        log.warning("damaged record at byte %d: %s", lost, why)
                else:
                    if lost >= 0:
                        self._quarantine(lost, at)
                        lost = -1
                    yield record
                    at = end
                    file.forget(at)
                    continue
            at = file.find((GZIP_START, VERSION_START), search)
        if 0 <= lost < file.size:
            self._quarantine(lost, file.size)

    def _quarantine(self, begin: int, end: int) -> None:
        if end > begin:
            log.warning("quarantined bytes %d to %d", begin, end)
            self.gaps.append((begin, end - begin))


# ---- tables ----


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(id, url, payload, digest, length, refers_to)``: the page a page repeats, or null.

    Payloads are counted by digest with map-side combine, and only digests of several rows are
    joined back; the join of a digest that very many rows share is split by adaptive execution.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("length") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    marked = rows.join(firsts.where("n > 1").select("digest", "first"), "digest", "left")
    repeats = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    return marked.withColumn("refers_to", F.when(repeats, F.col("first"))).drop("first")


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a gzip-member WARC record per row below ``folder`` and return its manifest ``(file, records, bytes)``.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes the one with the smallest id
    becomes a response and the others revisits of it (rows that repeat that id are responses too);
    shorter ones are all responses. A null payload is empty, a null URL has no header, a null id
    is kept as null, other ids are percent-encoded in their header and an empty table writes nothing. ``folder`` must be open to all executors.
    Every task attempt writes files of its own and the manifest, itself a written table, names only
    those of attempts that succeeded, so a lost executor or a second attempt leaves no doubles.
    """
    rows = with_revisits(pages, id_col, url_col, html_col)
    rows = rows.select(F.col("id").cast("string"), "url", "payload", "digest", "length", F.col("refers_to").cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        made: list[tuple[str, int, int]] = []
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(root, recursive=True)
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["length"], row["refers_to"], date)
                data = zipper.compress(data) + zipper.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    made.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, count, size))
        if made:
            names, counts, sizes = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{n}" for n in names]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"]
            )

    return stored(rows.mapInArrow(write, "file string, records bigint, bytes bigint"))


RECORD_SCHEMA = (
    "file string, offset bigint, inner_offset bigint, bytes bigint, gap boolean, record_type string, page string, url string, "
    "payload_bytes bigint, payload_digest string, refers_to string"
)


def read_warc(files: DataFrame, file_col: str = "file", with_payload: bool = False) -> DataFrame:
    """Records and gaps of archives, one task per file at most, read as streams.

    One row per record ``(file, offset, inner_offset, bytes, gap = false, record_type, page, url, payload_bytes,
    payload_digest, refers_to)`` and, with ``with_payload``, the stored payload (empty for revisits).
    ``offset`` is that of the gzip member or plain record, ``inner_offset`` the place in the inflated
    member (null in plain files), ``bytes`` the record's length there. A row with ``gap = true`` logs bytes
    that no sound record could be read from, of the file or, with an ``inner_offset``, of an inflated
    member; their other columns are null. Digest and size are those of the full payload, for revisits as their header
    has them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        held: list[tuple] = []
        volume = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as stream:
                    reader = SalvageReader(stream)
                    for record in reader:
                        held.append((path, record.offset, record.inner, record.length, False, *_described(record, with_payload)))
                        volume += len(record.block) if with_payload else 256
                        if volume > 16 * CHUNK:
                            yield _batch(held, names)
                            held, volume = [], 0
                    gaps = [(at, None, size) for at, size in reader.gaps] + reader.inner_gaps
                    held += [(path, *gap, True, *[None] * (len(names) - 5)) for gap in gaps]
        if held:
            yield _batch(held, names)

    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")
    return files.select(F.col(file_col)).mapInArrow(read, schema)


def _described(record: Record, with_payload: bool) -> tuple:
    head = record.headers
    kind, payload = head["warc-type"], record.payload
    digest = head.get("warc-payload-digest", "").partition(":")[2] if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    size = int(head.get("x-payload-length", "0")) if kind == "revisit" else len(payload)
    page, first = (None if v is None else unquote(v) for v in (head.get("x-page-id"), head.get("x-page-refers-to")))
    told = (kind, page, head.get("warc-target-uri"), size, digest, first)
    return (*told, payload) if with_payload else told


_TYPES = {"offset": pa.int64(), "inner_offset": pa.int64(), "bytes": pa.int64(), "gap": pa.bool_(), "payload_bytes": pa.int64(), "payload": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all rows to archives in the shared folder, read them back and describe each record by its page."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(pages, folder, id_col, url_col, html_col)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    files = manifest.select("file").repartition(max(1, manifest.count()))
    return read_warc(files).where(~F.col("gap")).select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "file", "offset"
    )
