"""WARC archives: write, index, and read selected records by coalesced byte ranges.

``write`` stores pages as .warc.gz files of one gzip member per record in the shared folder, one file for a task, of which
only those of successful tasks are known. ``index`` streams through the files once and gives offset, length, URL and
digest of every record. ``read`` takes any selection of index rows: they are spread by file and stretch of ``stretch``
bytes, as many tasks as stretches, sorted by offset within each task, and ranges less than ``gap`` bytes apart are read at once,
up to ``most`` bytes; nothing between stretches without a selected record is read. Payload digests are checked on reading.

Files may come from elsewhere: plain .warc files, field names in any case, ``response`` records (the HTTP
head is split off, chunked and compressed bodies are undone), SHA-1, SHA-256 and MD5 digests in base 16 or 32 (others aren't
checked), texts that aren't UTF-8 (replaced). Nothing is lost silently: bytes that are no whole record (a cut end, damage, trailing
bytes) are an index row of their own with ok false and without URL, up to the next place where a record begins; read gives such a row back with
ok false and a null html. Of a gzip member with several records (an archive compressed as a whole) only the first is indexed.

Defined results: a null url is written without a target, a null html as an empty payload with a field that says so, and both come back
null; equal rows are records of their own; page ids may be null or repeated; an empty table
writes no record and gives an empty index; a record whose payload doesn't match its digest comes back with ok false. Only
page_id, url and html are stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C


@dataclass(frozen=True)
class Settings:
    stretch: int = 64_000_000
    gap: int = 256_000
    most: int = 8_000_000
    level: int = 1  #: of compression


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def digest(payload: bytes) -> str:
    return "sha1:" + hashlib.sha1(payload).hexdigest()


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One WARC/1.1 resource record, not compressed."""
    body = (html or "").encode()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
        if unquote(head[-1][17:]) != url or quote(url, safe="%/:=&?~#+!$,;'@()*[]") != url:
            head.append("X-Target: " + quote(url, safe=""))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if html is None:
        head.append("X-Payload: none")
    else:
        head.append("WARC-Payload-Digest: " + digest(body))
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Fields of a head by lower-case name, without its first line."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; ValueError if it isn't whole."""
    head, end, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    if not head.startswith(b"WARC/") or not end or not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        raise ValueError("no whole record")
    return fields, rest[: int(fields["content-length"])]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload(fields: dict[str, str], block: bytes) -> tuple[bytes, list[bytes]]:
    """What a record holds, and what its digest may be of: the block's payload as stored, or without its transfer coding."""
    if fields.get("warc-type", "").lower() != "response" or not block.startswith(b"HTTP/"):
        return block, [block]
    head, _, body = block.partition(b"\r\n\r\n")
    http, seen = _fields(head), [body]
    try:
        if http.get("transfer-encoding", "").lower() == "chunked":
            body = _dechunked(body)
            seen.append(body)
        if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
            body = zlib.decompress(body, 47)
    except (ValueError, zlib.error):
        pass  # a body that isn't coded as its head says is given as it is
    return body, seen


def matches(want: str | None, bodies: list[bytes]) -> bool:
    """Whether a digest is that of one of the bodies; without a digest, or with one of another kind, nothing is wrong."""
    kind, _, value = (want or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True
    for b in bodies:
        d = hashlib.new(kind.lower(), b)
        if value.lower() == d.hexdigest() or value.upper().rstrip("=") == base64.b32encode(d.digest()).decode().rstrip("="):
            return True
    return False


def _url(fields: dict[str, str]) -> str | None:
    return unquote(fields["x-target"]) if "x-target" in fields else fields["warc-target-uri"].strip("<>") if "warc-target-uri" in fields else None


def _page(fields: dict[str, str]) -> int | None:
    return int(fields["x-page-id"]) if fields.get("x-page-id", "").lstrip("-").isdigit() else None


def write(pages: DataFrame, folder: str, s: Settings = Settings()) -> DataFrame:
    """Write pages; gives (file, records) of each file."""

    def run(batches):
        fs, path = _open(folder)
        out, name, n = None, f"{path}/{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                z = zlib.compressobj(s.level, zlib.DEFLATED, 31)
                out.write(z.compress(record(page_id, url, html)) + z.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], ["file", "records"])

    return C.saved(C.arrow(pages.select("page_id", "url", "html")).mapInArrow(run, "file string, records long"))


MAGIC = b"\x1f\x8b\x08"


def members(stream, block: int = 1 << 17) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, content) of each gzip member; content is None for bytes that are no whole member."""
    at, data, over = 0, b"", False

    def more() -> bool:
        nonlocal data, over
        got = b"" if over else stream.read(block)
        over = over or not got
        data += got
        return bool(got)

    while data or more():
        z, out, fed, ok = zlib.decompressobj(31), [], 0, True
        try:
            while not z.eof:
                if fed == len(data) and not more():
                    ok = False
                    break
                out.append(z.decompress(data[fed:]))
                fed = len(data) - len(z.unused_data)
        except zlib.error:
            ok = False
        if ok:
            yield at, fed, b"".join(out)
        else:  # to where the next member may begin
            while (fed := data.find(MAGIC, 1)) < 0 and more():
                pass
            fed = len(data) if fed < 0 else fed
            yield at, fed, None
        at, data = at + fed, data[fed:]


def plain(stream, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes | None]]:
    """The same for the records of a file that isn't compressed."""
    at, data, over = 0, b"", False

    def upto(n: int) -> bool:
        nonlocal data, over
        while len(data) < n and not over:
            got = stream.read(max(block, n - len(data)))
            over = not got
            data += got
        return len(data) >= n

    while upto(1):
        end = -1
        while data.startswith(b"WARC/") and (end := data.find(b"\r\n\r\n")) < 0 and upto(len(data) + 1):
            pass
        size = _fields(data[:end]).get("content-length", "") if end >= 0 else ""
        n = end + 4 + int(size) if size.isdigit() else 0
        if n and upto(n):
            while n < end + 8 + int(size) and upto(n + 2) and data[n : n + 2] == b"\r\n":
                n += 2
            yield at, n, data[:n]
        else:
            while (n := data.find(b"WARC/1.", 1)) < 0 and upto(len(data) + 1):
                pass
            n = len(data) if n < 0 else n
            yield at, n, None
        at, data = at + n, data[n:]


def records(stream) -> Iterator[tuple[int, int, bytes | None]]:
    """Members or plain records, by the file's first bytes."""

    class Peeked:
        first = stream.read(len(MAGIC))

        def read(self, n: int) -> bytes:
            got, self.first = self.first, b""
            return got + stream.read(n)

    s = Peeked()
    return plain(s) if s.first.startswith(b"WAR") else members(s)


def index(files: DataFrame) -> DataFrame:
    """(file, offset, length, url, digest, page_id, kind, ok) of every record. A member of several records gives a row for its first."""

    def row(file, offset, length, data):
        try:
            fields, _ = parsed(data or b"")
        except ValueError:
            return file, offset, length, None, None, None, None, False
        return file, offset, length, _url(fields), fields.get("warc-payload-digest"), _page(fields), fields.get("warc-type"), True

    def run(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, path = _open(file)
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for offset, length, data in records(f):
                        rows.append(row(file, offset, length, data))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], NAMES)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], NAMES)

    spread = files.select("file").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(run, "file string, offset long, length long, url string, digest string, page_id long, kind string, ok boolean")


NAMES = ["file", "offset", "length", "url", "digest", "page_id", "kind", "ok"]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first row, last row + 1) of the reads for sorted (offset, length) rows."""
    a = 0
    while a < len(rows):
        b, end = a + 1, rows[a][0] + rows[a][1]
        while b < len(rows) and rows[b][0] - end <= gap and rows[b][0] + rows[b][1] - rows[a][0] <= most:
            end = max(end, rows[b][0] + rows[b][1])
            b += 1
        yield rows[a][0], end, a, b
        a = b


def read(selected: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(page_id, url, digest, html, ok) of the selected index rows."""

    def record_of(data: bytes):
        try:
            fields, block = parsed(zlib.decompress(data, 31) if data.startswith(MAGIC) else data)
        except (ValueError, zlib.error):
            return None, None, None, None, False
        body, bodies = payload(fields, block)
        want = fields.get("warc-payload-digest")
        return _page(fields), _url(fields), want, None if fields.get("x-payload") == "none" else body.decode("utf-8", "replace"), matches(want, bodies)

    def run(batches):
        pending: list[tuple[str, int, int]] = []

        def fetch(rows):
            out = []
            at = 0
            while at < len(rows):
                file, end = rows[at][0], at
                while end < len(rows) and rows[end][0] == file:
                    end += 1
                fs, path = _open(file)
                with fs.open_input_file(path) as f:
                    own = [(o, n) for _, o, n in rows[at:end]]
                    for start, stop, a, b in ranges(own, s.gap, s.most):
                        data = f.read_at(stop - start, start)
                        for o, n in own[a:b]:
                            out.append(record_of(data[o - start : o - start + n]))
                            if len(out) == 500:
                                yield out
                                out = []
                at = end
            if out:
                yield out

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()])], ["page_id", "url", "digest", "html", "ok"])

        for b in batches:
            pending += zip(*(c.to_pylist() for c in b.columns))
            if len(pending) > 50_000:
                yield from map(batch, fetch(pending))
                pending = []
        yield from map(batch, fetch(pending))

    place = C.saved(selected.select("file", "offset", "length", F.floor(F.col("offset") / s.stretch).alias("_stretch")))
    tasks = max(1, place.select("file", "_stretch").distinct().count())  # a number that is asked for isn't coalesced
    spread = place.repartition(tasks, "file", "_stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return spread.mapInArrow(run, "page_id long, url string, digest string, html string, ok boolean")


def first_captures(records: DataFrame) -> DataFrame:
    """Of each URL the page (resource or response) with the smallest page_id (nulls last), then the smallest digest."""
    w = Window.partitionBy("url").orderBy(F.col("page_id").asc_nulls_last(), F.col("digest").asc_nulls_last(), "file", "offset")
    return records.filter("url is not null and lower(kind) in ('resource', 'response')").withColumn("_nr", F.row_number().over(w)).filter("_nr = 1").drop("_nr")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, indexed, and the first capture of each URL read back."""
    folder = f"{C.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = C.saved(index(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)))
    return read(first_captures(records))


SQL = """
SELECT page_id, url, 'sha1:' || sha1(html) AS digest, html, true AS ok
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id NULLS LAST, sha1(html) NULLS LAST) AS nr FROM pages WHERE url IS NOT NULL)
WHERE nr = 1
"""
