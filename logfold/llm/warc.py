"""WARC archives in Zstandard: writer with deduplicated revisits, and a reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
compression dictionary, followed by one Zstandard frame per record.  The
dictionary is trained by each writing task on the first records of its
archive (at most ``DICT_SAMPLES`` records, ``DICT_SAMPLE_BYTES`` bytes).

The writer rolls to a new archive at ``ARCHIVE_BYTES``.  Archives have unique
names and count only through the manifest, a table that Spark commits, so a
lost or repeated task leaves at most an orphan file that no reader opens.  The
folder must be shared by all executors (``spark.checkpoint.dir`` by default);
any file system that pyarrow knows will do.

``read_archives`` opens the archives of a manifest in tasks and streams them
frame by frame; ``read_binary`` reads the rows of Spark's ``binaryFile``
source, for archives in a store that only Spark reaches.  Both load the
dictionary from the leading frame and check each record: version line, header
syntax, Content-Length against the block, the record's closing, frame end,
and the payload digest.  A faulty record is a row with its ``error``; records
after it in the archive are still read while frames can be found.  After a
damaged frame reading goes on where its block headers say that it ends, if a
frame or the end of the archive is there, or else at the next frame magic that
starts a sound frame or a damaged one with a known end; what lies between
gives no further row.

Defined results: a null payload is empty; a null URL leaves out the target
header and line ends in a URL are written as %0D and %0A; a null id is kept as null; records with equal payloads under the
minimum size are all responses; rows that repeat the id of the response are
responses too; if all ids of equal payloads are null, all are responses.
Only the id, url and payload columns are read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.folders import shared_folder
from logfold.staging import stage

DICT_MAGIC = 0x184D2A5D
SKIP_MAGICS = range(0x184D2A50, 0x184D2A60)
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 32 << 10
DICT_SAMPLES = 200
DICT_SAMPLE_BYTES = 2 << 20
MIN_REVISIT_BYTES = 100
LEVEL = 3
_READ = 1 << 18
_FRAME = b"\x28\xb5\x2f\xfd"
_MAGIC = re.compile(rb"\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18")
_BLOCK_BYTES = 128 << 10  # bound of the format
_LOST_SKIP_BYTES = 1 << 20  # in a search for the next frame, larger skippable frames are searched through
_FIELDS = ["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "error"]


def _record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page}:{digest}'.encode()).hexdigest())}>"


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One WARC record with an HTTP response block; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; ValueError names the first fault."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("record header does not end")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("bad version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("bad header line")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    if not fields["content-length"].isdecimal():
        raise ValueError("bad Content-Length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    block, kind = rest[:n], fields["warc-type"]
    payload, length = block, n
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        if not found or len(sizes) > 1 or not all(s.isdigit() for s in sizes):
            raise ValueError("bad HTTP header")
        length = int(sizes[0]) if sizes else len(payload)
        if kind != "revisit" and length != len(payload):
            raise ValueError("HTTP Content-Length differs from the payload")
    digest = fields.get("warc-payload-digest", "").partition(":")
    if kind != "revisit" and digest[0] == "sha256" and hashlib.sha256(payload).hexdigest() != digest[2]:
        raise ValueError("payload digest differs")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {"page_id": int(page) if page else None, "record_type": kind,
            "url": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload, "payload_bytes": length,
            "payload_digest": digest[2] or hashlib.sha256(payload).hexdigest(),
            "refers_to": int(refers) if refers else None, "error": None}


class ArchiveWriter:
    """Collects records of one archive: leading dictionary frame, then one frame per record."""

    def __init__(self) -> None:
        self.out, self.waiting, self.waiting_bytes, self.records = io.BytesIO(), [], 0, 0
        self.compress = None

    def _start(self) -> None:
        import zstandard

        samples = [r[:65536] for r in self.waiting]
        data = b""
        try:  # too few or too small samples: no dictionary, no leading frame
            data = zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes() if len(samples) >= 8 else b""
        except zstandard.ZstdError:
            data = b""
        if data:
            self.out.write(struct.pack("<II", DICT_MAGIC, len(data)) + data)
        made = zstandard.ZstdCompressionDict(data) if data else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True, write_content_size=True).compress
        for r in self.waiting:
            self.out.write(self.compress(r))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compress:
            self.out.write(self.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if len(self.waiting) >= DICT_SAMPLES or self.waiting_bytes >= DICT_SAMPLE_BYTES:
            self._start()

    def size(self) -> int:
        return self.out.tell() + self.waiting_bytes * bool(self.waiting)

    def finish(self) -> bytes:
        if not self.compress:
            self._start()
        return self.out.getvalue()


class _Ahead:
    """The bytes of a stream that come next, read as they are asked for."""

    def __init__(self, stream: io.RawIOBase) -> None:
        self.stream, self.held = stream, b""

    def reach(self, n: int) -> bool:
        """Whether n more bytes are there; they are held then."""
        if len(self.held) < n:
            parts, size = [self.held], len(self.held)
            while size < n and (more := self.stream.read(_READ)):
                parts.append(more)
                size += len(more)
            self.held = b"".join(parts)
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        self.held = self.held[n:]

    def is_boundary(self, at: int) -> bool:
        """Whether a frame starts, or the stream ends, at this place."""
        return bool(_MAGIC.match(self.held, at)) if self.reach(at + 4) else len(self.held) == at

    def seek_magic(self) -> bool:
        """Drop what comes before the next frame magic; False if there is none."""
        while not (m := _MAGIC.search(self.held)):
            if not (more := self.stream.read(_READ)):
                return False
            self.held = self.held[-3:] + more
        self.drop(m.start())
        return True


def _frame_end(ahead: _Ahead) -> int | None:
    """Length of the frame that comes next by its header and block headers; None unless a boundary follows."""
    if not ahead.reach(5) or ahead.held[:4] != _FRAME:
        return None
    flags = ahead.held[4]
    single = flags >> 5 & 1
    at = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while ahead.reach(at + 3):
        block = int.from_bytes(ahead.held[at:at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3 or size > _BLOCK_BYTES:
            return None
        at += 3 + (1 if kind == 1 else size)
        if last:
            at += 4 * (flags >> 2 & 1)
            return at if ahead.is_boundary(at) else None
    return None


def read_frames(stream: io.RawIOBase) -> Iterator[bytes | ValueError]:
    """The content of each frame of an archive, one at a time; one error for each damaged frame, then the frames after it."""
    import zstandard

    ahead, dictionary, first = _Ahead(stream), None, True
    lost = False  # after an error row, while no frame has been found yet
    while ahead.reach(1):
        if lost and not ahead.seek_magic():
            return
        magic = int.from_bytes(ahead.held[:4], "little") if ahead.reach(4) else 0
        if magic in SKIP_MAGICS:
            size = int.from_bytes(ahead.held[4:8], "little") if ahead.reach(8) else 0
            whole = len(ahead.held) >= 8 and (size <= _LOST_SKIP_BYTES or not lost) and ahead.reach(8 + size)
            error = None if whole else "skippable frame is cut off"
            if whole and first and magic == DICT_MAGIC:
                try:
                    data = ahead.held[8:8 + size]
                    if data[:4] == _FRAME:  # the dictionary may itself be compressed
                        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                    dictionary = zstandard.ZstdCompressionDict(data)
                except zstandard.ZstdError as e:
                    error = f"bad dictionary: {e}"
            first = False
            sure = whole and ahead.is_boundary(8 + size)
            if not lost and not sure:
                error = error or "no frame follows the skippable frame"
            if error and not lost:
                yield ValueError(error)
            ahead.drop(8 + size if sure else 4)  # a wrong size must not hide the frames that follow
            lost = not sure
            continue
        first = False
        data, raw, parts, error = ahead.held, [], [], None
        ahead.held = b""
        try:
            frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            while True:
                raw.append(data)
                parts.append(frame.decompress(data))
                if frame.eof:
                    break
                if not (data := stream.read(_READ)):
                    error = "frame is cut off"
                    break
        except zstandard.ZstdError as e:
            error = f"bad frame: {e}"
        if error is None:
            ahead.held, content = frame.unused_data, b"".join(parts)
            if not lost or content.startswith(b"WARC/") or ahead.is_boundary(0):
                lost = False
                yield content
                continue
            ahead.held = b"".join(raw) + ahead.held[len(frame.unused_data):]
        else:
            ahead.held = b"".join(raw)
        # In a search a frame without a known end is no frame: these are bytes of the damaged one.
        end = _frame_end(ahead) if error else None
        if error and (end or not lost):
            yield ValueError(error)
        lost = end is None
        ahead.drop(end or 1)


def read_records(stream: io.RawIOBase) -> Iterator[dict]:
    for data in read_frames(stream):
        try:
            if isinstance(data, ValueError):
                raise data
            yield parse_record(data)
        except ValueError as e:
            yield dict.fromkeys(_FIELDS) | {"error": str(e)}


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every row; refers_to is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Only payloads that occur again take part in the join; copies are combined map-side.
    again = stage(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
        .select("digest", "first"), "warc-again")
    return rows.join(again, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``mark_revisits`` under ``folder``; returns the manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def close(w: ArchiveWriter) -> pa.RecordBatch:
            data = w.finish()
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "records": [w.records], "bytes": [len(data)]})

        w = ArchiveWriter()
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            for k in range(b.num_rows):
                page, url, refers = (cols[c][k].as_py() for c in ("page_id", "url", "refers_to"))
                w.add(build_record(page, url, cols["payload"][k].as_py(), cols["digest"][k].as_py(), refers, refers is not None))
                if w.size() >= archive_bytes:
                    yield close(w)
                    w = ArchiveWriter()
        if w.records:
            yield close(w)

    return stage(records.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


_SCHEMA = ("path string, page_id long, record_type string, url string, payload binary, payload_bytes long, "
           "payload_digest string, refers_to long, error string")


def _batches(path: str, stream: io.RawIOBase, payloads: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
                      ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("refers_to", pa.int64()), ("error", pa.string())])
    rows, size = [], 0
    for r in read_records(stream):
        size += len(r["payload"] or b"") if payloads else 0
        rows.append({"path": path, **r, "payload": r["payload"] if payloads else None})
        if len(rows) >= 1000 or size >= 8 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=kind)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives named by ``manifest.path``, opened in tasks and streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as f:
                    yield from _batches(path, f, payloads)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, _SCHEMA)


def read_binary(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The same for rows (path, content) of Spark's ``binaryFile`` source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from _batches(b.column(0)[k].as_py(), io.BytesIO(b.column(1)[k].as_py()), payloads)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives and read them back: the records without their payloads."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages, **columns), folder), payloads=False)
