"""WARC records in ZIP packages: writing with revisits, reading by range without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz`` (each record a gzip member of its own) and
``indexes/index.cdxj`` (record places). Tasks write packages of bounded size under names of their own; a
table of the finished ones is the result, so what a lost or repeated task leaves behind is never read.

Reading: the end of the file gives the central directory (or, by its ZIP64 locator, the ZIP64 one); its entries and the
local headers give the places of stored members. Index lines become runs of neighbouring records of about ``RUN``
bytes, dealt over the cluster; each run is one range read. A record archive that no index line names is walked
record by record for its places. Files are opened through Arrow's file systems, so any store they know serves.

Duplicates: of records with equal payloads of at least ``least`` bytes, the one with the largest id is a response, the others
are revisits that name it; they hold the HTTP headers, with the payload's length, but no payload.

Defined cases: a null html is empty; a null url is an empty target; control characters, blanks and characters beyond ASCII in a url are
percent-encoded; a null id is smaller than any id and written as an empty name; repeated rows of the response's id are
responses too; an empty table gives no packages and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascope.llm import text as X

PACKAGE = 64 << 20      # bytes of records after which a task begins another package
RECORDS = 200_000       # records of a package at most
RUN = 2 << 20           # bytes of neighbouring records read at once (one record at least)
TASK = 8 << 20          # bytes of runs for one reading task
DUPLICATES_BROADCAST = 200_000  # digests (one short row each) that may be broadcast
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RUNS = "path string, start long, ends array<long>, packed boolean"
FOUND = ("record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, "
         "refers_to string, path string, offset long, length long")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a path or URI; Hadoop writes local ones with one slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


# ---- writing -------------------------------------------------------------------------------------
def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record; with ``refers_to`` (a record name) a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    more = f"WARC-Refers-To: {refers_to}\r\nWARC-Profile: {PROFILE}\r\n" if refers_to else ""
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")
    head = (f"WARC/1.1\r\nWARC-Type: {'revisit' if refers_to else 'response'}\r\nWARC-Record-ID: {name_of(page_id)}\r\n"
            f"WARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha1:{digest_of(payload)}\r\n{more}"
            f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


class _Stream:
    """An output stream without seeking, which the ZIP writer then does without too."""

    def __init__(self, out):
        self.write, self.flush, self.tell, self.close = out.write, out.flush, out.tell, out.close


class Package:
    """A ZIP file being written."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        store, inner = open_store(folder)
        store.create_dir(inner, recursive=True)
        store, inner = open_store(self.path)
        self.out = store.open_output_stream(inner)
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines, self.size = [], 0

    def add(self, raw: bytes, target: str) -> None:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = squeeze.compress(raw) + squeeze.flush()
        self.member.write(data)
        place = {"url": target, "offset": str(self.size), "length": str(len(data)), "filename": DATA.split("/")[1]}
        self.lines.append(f"{quote(target)} 20000101000000 {json.dumps(place)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.close()
        self.out.close()
        return self.path, self.size, len(self.lines)


def revisited(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html; null html empty) and ``winner``, the id of the response for payloads that occur more than once.
    Only digests are counted; with more than ``DUPLICATES_BROADCAST`` repeated ones the pages are joined by shuffle,
    where a hot digest is a skewed join of one short row, which Spark splits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    long_enough = F.octet_length("html") >= least
    again = (rows.where(long_enough).groupBy(F.unhex(F.sha1("html")).alias("digest"))
             .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "winner"))
    again = X.small(X.written(again, "payloads"), DUPLICATES_BROADCAST)
    key = F.when(long_enough, F.unhex(F.sha1("html")))
    return rows.join(again, key == F.col("digest"), "left").select("page_id", "url", "html", "winner")


def write_packages(pages: DataFrame, folder: str, least: int = 0, package: int = PACKAGE) -> DataFrame:
    """Write every row of ``pages`` as a record; returns the written table (path, bytes, records) of the packages."""
    def run(batches):
        open_, done = None, []
        for batch in batches:
            for part in X.slices(batch, "html"):
                for page, url, html, winner in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "winner"))):
                    open_ = open_ or Package(folder)
                    refers = None if winner is None or winner == page else name_of(winner)
                    open_.add(record(page, url, html.encode(), refers), url or "")
                    if open_.size >= package or len(open_.lines) >= RECORDS:
                        done.append(open_.close())
                        open_ = None
            X.tidy()
        if open_:
            done.append(open_.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(3)], names=["path", "bytes", "records"])

    return X.written(revisited(pages, least).mapInArrow(run, "path string, bytes long, records long"), "packages")


# ---- reading -------------------------------------------------------------------------------------
def central_directory(f, size: int) -> tuple[int, int, int]:
    """Place, length and entry count of the central directory, from the end record or its ZIP64 form."""
    base = max(size - 22 - 0xFFFF, 0)
    tail = f.read_at(size - base, base)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0 or len(tail) < at + 22:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack("<HLL", tail[at + 10:at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        sign, _, place, _ = struct.unpack("<4sLQL", f.read_at(20, base + at - 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        sign, *_, count, length, start = struct.unpack("<4sQHHLLQQQQ", f.read_at(56, place))
        if sign != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
    return start, length, count


def stored_members(f, size: int) -> dict[str, tuple[int, int]]:
    """Place and length of the data of each stored member."""
    start, length, count = central_directory(f, size)
    raw, at, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        sign, _, _, _, method, _, _, _, packed, full, names, extras, comment, *_, place = struct.unpack("<4s6H3L5H2L", raw[at:at + 46])
        if sign != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        name = raw[at + 46:at + 46 + names].decode("utf-8", "replace")
        extra, at = raw[at + 46 + names:at + 46 + names + extras], at + 46 + names + extras + comment
        while len(extra) >= 4:  # ZIP64 sizes stand in this order, those only that do not fit above
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                place = wide.pop(0) if place == 0xFFFFFFFF else place
            extra = extra[4 + n:]
        if method == 0:
            skip = struct.unpack("<HH", f.read_at(4, place + 26))
            out[name] = (place + 30 + sum(skip), packed)
    return out


def _walk(f, start: int, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    """Places of the records of an archive without an index, read once in pieces."""
    at, end = start, start + size
    while at < end:
        begin = at
        if packed:
            open_ = zlib.decompressobj(31)
            while not open_.eof and at < end:
                piece = f.read_at(min(1 << 16, end - at), at)
                open_.decompress(piece)
                at += len(piece) - len(open_.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head and begin + len(head) < end:
                head += f.read_at(min(1 << 12, end - begin - len(head)), begin + len(head))
            length = _headers(head.partition(b"\r\n\r\n")[0])["content-length"]
            at = begin + head.index(b"\r\n\r\n") + 4 + int(length) + 4
        yield begin, at - begin


def places(path: str) -> Iterator[tuple[int, int, bool]]:
    """(offset in the file, length, gzipped) of every record of a package."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as f:
        members = stored_members(f, f.size())
        archives = {n.split("/")[-1]: n for n in members if n.endswith((".warc", ".warc.gz"))}
        named = set()
        for name in members:
            if name.endswith((".cdx", ".cdxj")):
                start, length = members[name]
                for line in f.read_at(length, start).splitlines():
                    entry = json.loads(line[line.index(b"{"):])
                    of = archives[entry["filename"].split("/")[-1]]
                    named.add(of)
                    yield members[of][0] + int(entry["offset"]), int(entry["length"]), of.endswith(".gz")
        for of in archives.values():
            if of not in named:
                yield from ((at, n, of.endswith(".gz")) for at, n in _walk(f, *members[of], of.endswith(".gz")))


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


def parse(raw: bytes) -> dict:
    """The fields of a record; digest and length are taken from the payload, or, of a revisit, from what it says."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    out = {"record_id": warc.get("warc-record-id"), "record_type": warc["warc-type"], "target_uri": warc.get("warc-target-uri"),
           "refers_to": warc.get("warc-refers-to")}
    http, _, payload = block.partition(b"\r\n\r\n") if warc.get("content-type", "").startswith("application/http") else (b"", b"", block)
    said = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "revisit":
        length = _headers(http).get("content-length")
        return out | {"payload_bytes": None if length is None else int(length), "payload_digest": said}
    found = digest_of(payload)
    if said and said != found:
        raise ValueError(f"record {out['record_id']}: payload does not match its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": found}


def runs(packages: DataFrame) -> DataFrame:
    """Runs of neighbouring records: (path, start, ends, packed), one row for about ``RUN`` bytes."""
    def locate(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[list] = []
                for at, n, packed in sorted(places(path)):
                    last = rows[-1] if rows else None
                    if last and last[2][-1] == at and last[3] == packed and at + n - last[1] <= RUN:
                        last[2].append(at + n)
                    else:
                        rows.append([path, at, [at + n], packed])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_()))],
                    names=["path", "start", "ends", "packed"])

    count = packages.count()
    return packages.select("path").repartition(max(1, min(count, 10_000))).mapInArrow(locate, RUNS)


def read_packages(packages: DataFrame) -> DataFrame:
    """The records (``FOUND``) of the packages in the column ``path``."""
    spans = X.written(runs(packages), "runs")
    total = spans.agg(F.sum(F.element_at("ends", -1) - F.col("start"))).first()[0] or 0

    def read(batches):
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in FOUND.split(", ")]
        for batch in batches:
            for path, start, ends, packed in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = open_store(path)
                with store.open_input_file(inner) as f:
                    data = f.read_at(ends[-1] - start, start)
                out, at = [], start
                for end in ends:
                    raw = data[at - start:end - start]
                    out.append(parse(zlib.decompress(raw, 31) if packed else raw) | {"path": path, "offset": at, "length": end - at})
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)
            X.tidy()

    return spans.repartition(max(1, min(total // TASK + 1, 20_000))).mapInArrow(read, FOUND)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages in the shared folder, read them back: one row per page."""
    found = read_packages(write_packages(pages, X.scratch(spark, "wacz")))

    def id_of(c: str):
        text = F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
        return F.when(text != "", text).cast(pages.schema["page_id"].dataType)

    return found.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        id_of("refers_to").alias("refers_to"))
