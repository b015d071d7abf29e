"""WARC archives: a writer that turns repeats into revisits, and a salvage reader.

The writer puts one gzip member per record into files of bounded size. The
reader takes any number of records in a member, folded headers, and digests in
base 32 or hexadecimal. It checks every record (member checksum, version line,
headers, length, block digest). After a failed check it searches for the next
member that inflates to a version line, or the next version line of a plain
archive, goes on from there, and logs the bytes between as a quarantined gap. A
payload digest is optional in the format, so one that differs or is of no known form
is a flaw of a record that is kept. A member that inflates to over MOST bytes is a
gap, so that no archive fills a task's memory.

Files are read in a moving window, one file a task, so memory follows the
largest member. Of several records in a member the first has its length, the others
none. Defined cases: a null payload is empty; a null url has no target
header; a null page id is written without one, and revisits any equal payload that
has an id; rows that repeat the largest page id of equal payloads are all
responses; an empty table writes nothing; an empty archive has no records and no
gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.shared import new_path, open_fs, partitions, stored

FILE_BYTES, REVISIT_BYTES, WINDOW, FILES_A_TASK = 32 << 20, 1000, 4 << 20, 4
#: Bytes that a member may inflate to.
MOST = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/[01]\.\d{1,2}\r\n")
RECORD = "path string, offset long, length long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, flaw string, gap string"


def _header(fields: list[tuple[str, object]], version: str = "WARC/1.1") -> bytes:
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in fields if v is not None]
    return "\r\n".join([version, *lines, "", ""]).encode("utf-8", "surrogatepass")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else digest)}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit holds the HTTP headers only."""
    digest = _digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisits:
        block += payload
    fields = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", _name(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or None),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Profile", PROFILE if revisits else None),
        ("WARC-Refers-To", _name(refers_to, digest) if revisits else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to if revisits else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Window:
    """Bytes of an open file by position, read in steps."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, begin: int, n: int) -> bytes:
        end = min(begin + n, self.size)
        if begin < self.at or end > self.at + len(self.data):
            self.data = self.file.read_at(max(n, WINDOW), begin)
            self.at = begin
        return self.data[begin - self.at : end - self.at]

    def find(self, mark: re.Pattern, begin: int) -> int:
        """Position of the next match, or the size."""
        while begin < self.size:
            part = self.get(begin, WINDOW)
            if m := mark.search(part):
                return begin + m.start()
            if begin + len(part) >= self.size:
                break
            begin += max(1, len(part) - 32)
        return self.size


def _member(w: Window, at: int) -> tuple[bytes, int]:
    """The inflated member at a position and its end; raises on damage."""
    z, out, pos, held = zlib.decompressobj(31), [], at, 0
    while not z.eof:
        if not (part := z.unconsumed_tail):
            part = w.get(pos, 1 << 20)
            pos += len(part)
        if not part:
            raise ValueError("member is cut off")
        out.append(z.decompress(part, 16 << 20))
        held += len(out[-1])
        if held > MOST:
            raise ValueError(f"member inflates to over {MOST} bytes")
    return b"".join(out), pos - len(z.unused_data)


def _plain(w: Window, at: int) -> tuple[bytes, int]:
    """The plain record at a position and its end; raises on damage."""
    head, size = b"", 1 << 14
    while (cut := (head := w.get(at, size)).find(b"\r\n\r\n")) < 0:
        if size >= 1 << 20 or at + size >= w.size:
            raise ValueError("headers have no end")
        size *= 4
    m = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", head[:cut], re.I)
    if not m:
        raise ValueError("no content length")
    end = at + cut + 4 + int(m[1]) + 4
    if end > w.size:
        raise ValueError("record is cut off")
    return w.get(at, end - at), end


def _sha1(said: str) -> str | None:
    """A labelled SHA-1 in base 32 or hexadecimal as bare lower-case hex; None for other algorithms; raises for what is neither."""
    kind, _, value = said.partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    raw = base64.b32decode(value.upper())
    if len(raw) != 20:
        raise ValueError("not a SHA-1")
    return raw.hex()


def _fields(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with white space goes on with the one before it."""
    fields: dict[str, str] = {}
    key = ""
    for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and key:
            fields[key] = f"{fields[key]} {line.strip()}".strip()
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header without a colon")
        key = key.strip().lower()
        fields[key] = value.strip()
    return fields


def parse(data: bytes, begin: int = 0) -> tuple[dict, int]:
    """Type, ids, url and payload of the record at a position, and its end; raises when a check fails."""
    if not VERSION.match(data, begin):
        raise ValueError("no version line")
    cut = data.find(b"\r\n\r\n", begin)
    if cut < 0:
        raise ValueError("headers have no end")
    fields = _fields(data[begin:cut])
    length = int(fields.get("content-length") or -1)
    end = cut + 4 + length
    if length < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length differs")
    block = data[cut + 4 : end]
    if (said := _sha1(fields.get("warc-block-digest", ""))) and said != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = fields.get("warc-type", "")
    size = int(m[1]) if kind == "revisit" and (m := re.search(rb"\r\nContent-Length:[ \t]*(\d+)", http, re.I)) else len(payload)
    own, flaw = hashlib.sha1(payload).hexdigest(), None
    try:
        digest = _sha1(fields.get("warc-payload-digest", "")) or own
        if kind != "revisit" and digest != own:
            digest, flaw = own, "payload digest differs"
    except ValueError:
        digest, flaw = own, "payload digest of no known form"
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d{1,18}", fields.get(k, "")) else None
    url = fields.get("warc-target-uri")
    url = url if url is None else url.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return {"record_type": kind, "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "url": url, "payload_bytes": size, "payload_digest": digest, "payload": payload, "flaw": flaw}, end + 4


def records(data: bytes) -> list[dict]:
    """All records of an inflated member or of one plain record; raises when a check of any fails."""
    found, at = [], 0
    while at < len(data) or not found:
        fields, at = parse(data, at)
        found.append(fields)
    return found


def salvage(file, size: int) -> Iterator[dict]:
    """Records (offset, length, fields) and gaps (offset, length, gap) of an archive, in order; together they cover it."""
    w = Window(file, size)
    at, bad, why = 0, None, ""
    while at < size:
        packed = w.get(at, 3) == GZIP
        try:
            data, end = _member(w, at) if packed else _plain(w, at)
            found = records(data)
        except (ValueError, zlib.error) as e:
            if bad is None:
                bad, why = at, str(e)
            # a member's start or a version line; a false one fails its checks and is searched past
            at = w.find(re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d{1,2}\r\n"), at + 1)
            continue
        if bad is not None:
            yield {"offset": bad, "length": at - bad, "gap": why}
            bad = None
        for i, fields in enumerate(found):
            yield {"offset": at, "length": 0 if i else end - at} | fields
        at = end
    if bad is not None:
        yield {"offset": bad, "length": size - bad, "gap": why}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of archives (column path); a gap has its reason in `gap` and no fields."""
    schema = _schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for r in salvage(f, f.size()):
                        if not payload:
                            r.pop("payload", None)
                        rows.append({"path": path} | r)
                        held += len(r.get("payload") or b"") + 200
                        if held > WINDOW:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # a fixed number of tasks: rows are few and small, their files are not
    n = partitions(files.sparkSession, files.count(), FILES_A_TASK)
    return files.select("path").repartition(n, "path").mapInArrow(run, RECORD)


def list_archives(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row; the manifest (path, n_records). Equal payloads of `least` bytes or more: the largest page id is the response."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    same = rows.where("key IS NOT NULL").groupBy(F.col("key").alias("k")).agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    # narrow and read twice by the plan: which keys repeat is a small part of the pages
    same = stored(same, "repeats")
    # a payload without a key meets nothing, in a partition of its own choosing
    at = F.coalesce("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"), F.lit(" ").cast("binary"), "payload"))))
    rows = rows.join(same, at == F.col("k"), "left").select("page_id", "url", "payload", "k", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, key, keep in zip(*batch.columns, strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                page_id, keep = page_id.as_py(), keep.as_py()
                revisits = key.is_valid and keep is not None and page_id != keep
                data = _gzip(record(page_id, url.as_py(), payload.as_py(), revisits, keep, date))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    return stored(rows.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write archives in the shared folder and read their records back; raises where one of its own records is not read."""
    manifest = write(pages, new_path(pages.sparkSession, "warc"), **options)
    rows = read(manifest, payload=False)
    lost = F.raise_error(F.concat(F.lit("a written record is not read: "), F.col("gap").cast("string"))).cast("string")
    return rows.where(F.when(F.col("gap").isNull(), True).otherwise(lost.cast("boolean")))
