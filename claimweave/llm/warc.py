"""Operator 4: write WARC archives, and read them back with a salvage reader.

Writing: one record per page, each its own gzip member, payload the html in UTF-8. Of records with
equal payloads of at least ``least`` bytes, those with the smallest page_id are ``response``, the
others ``revisit`` records that refer to it and have no body. Each task writes its rows to files of
at most ``FILE_BYTES`` of compressed data under a temporary name, renames them when complete, and
returns their names as rows; only files named by the tasks that Spark accepted are read, so a lost
executor or a repeated task leaves no record twice. Writing uses pyarrow's file systems, so the
folder may be any URI that they know (file, hdfs, s3 and s3a, gs, abfs).

Reading: files come through Spark's ``binaryFile`` source. A record that fails a check (gzip
checksum, WARC header, content length, block or payload digest) does not end the file: the reader
looks for the next byte at which a valid member (compressed files) or a version line (plain files)
begins, goes on there, and reports the gap as a ``quarantine`` row with its offset and length. It looks
inside members as well: a member may hold several records, of which those before and after a bad one are
kept, and of a damaged member what could be inflated, if a record's own digest vouches for it. The registered query
fails if what it reads back is not what the manifest says was written.

Cases: null html is an empty payload; a page_id may be null or repeated (rows of the smallest page_id
with equal payloads are all responses); an empty table writes no file and gives no rows; urls may be
null or hold any text (line breaks are percent-encoded in the header); other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import new_path, small, spread, starts, table, written

FILE_BYTES = 64 << 20
LEVEL = 6
VERSION = b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
RECORDS = "file string, position long, length long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, serial: str = "") -> bytes:
    """One WARC record, uncompressed."""
    body = b"" if revisit else payload
    target = "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url or "")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{serial}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(body)}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page": str(refers_to)}
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as one gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Bad(Exception):
    """A record or member that fails a check."""


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Header, body and end of the record that begins at ``at``; Bad if a check fails."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise Bad("header does not end")
    head = {}
    for row in data[line.end() : end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise Bad("header line without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Bad("no content length")
    body = data[end + 4 : end + 4 + int(length)]
    if len(body) < int(length):
        raise Bad("record is cut off")
    stop = end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("record does not end after its content length")
    for name, of in (("warc-block-digest", body), ("warc-payload-digest", None if head.get("warc-type") == "revisit" else body)):
        said = head.get(name, "")
        if of is not None and said.startswith("sha1:") and said[5:] != digest(of):
            raise Bad(f"{name} does not match")
    return head, body, stop + 4


def _inflate(data: bytes, at: int, step: int = 65536) -> tuple[bytes, int, str]:
    """Content, end and problem of the gzip member at ``at``; a damaged one has what came before the damage, and no end (-1)."""
    unpacker, out, here = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        while not unpacker.eof and here < len(data):
            piece = view[here : here + step]
            out.append(unpacker.decompress(piece))
            here += len(piece) - len(unpacker.unused_data)
    except zlib.error as e:
        if step > 64:  # once more in small steps, as the step that fails gives nothing
            return _inflate(data, at, 64)
        return b"".join(out), -1, str(e)
    return (b"".join(out), here, "") if unpacker.eof else (b"".join(out), -1, "member is cut off")


def _records(content: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(begin, end, header, body, problem) of the records of a text; after one that fails, of those from the next version line on that begins a good one."""
    at = 0
    while at < len(content):
        try:
            head, body, end = _parse(content, at)
            yield at, end, head, body, ""
            at = end
        except Bad as e:
            stop = len(content)
            for found in _VERSION_LINE.finditer(content, at + 1):
                try:
                    _parse(content, found.start())
                except Bad:
                    continue
                stop = found.start()
                break
            yield at, stop, None, b"", str(e)
            at = stop


def _good(data: bytes, at: int) -> bool:
    """Whether a whole member, or a record, begins here."""
    if data.startswith(_MAGIC, at):
        content, end, _ = _inflate(data, at)
        return end >= 0 and any(head is not None for _, _, head, _, _ in _records(content))
    try:
        _parse(data, at)
    except Bad:
        return False
    return True


def _next(data: bytes, at: int) -> int:
    """Where the next valid member or version line after ``at`` begins."""
    return next((found.start() for found in _START.finditer(data, at + 1) if _good(data, found.start())), len(data))


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(position, length, header, body, problem) of each record; a gap has no header and its problem. Records of a member have its position and length."""
    at = 0
    while at < len(data):
        if not data.startswith(_MAGIC, at):
            try:
                head, body, end = _parse(data, at)
                yield at, end - at, head, body, ""
            except Bad as e:
                end = _next(data, at)
                yield at, end - at, None, b"", str(e)
            at = end
            continue
        content, end, problem = _inflate(data, at)
        stop = end if end >= 0 else _next(data, at)
        for begin, upto, head, body, wrong in _records(content):
            if head is not None and (not problem or head.get("warc-block-digest", "").startswith("sha1:")):
                yield at, stop - at, head, body, ""
            elif head is None and not problem:
                yield at, stop - at, None, b"", f"{wrong} (bytes {begin} to {upto} of the member's content)"
        if problem:
            yield at, stop - at, None, b"", problem
        at = stop


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _reader(bodies: bool) -> object:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for position, length, head, body, problem in salvage(bytes(content)):
                    if head is None:
                        rows.append((path, position, length, "quarantine", None, None, None, None, None, None, problem))
                        continue
                    kind = head.get("warc-type", "")
                    size = _number(head.get("warc-payload-length")) if kind == "revisit" else len(body)
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else digest(body)
                    rows.append((path, position, length, kind, _number(head.get("warc-page-id")), head.get("warc-target-uri"), size, said, _number(head.get("warc-refers-to-page")), body if bodies else None, None))
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return read


def read_warc(files: DataFrame, bodies: bool = True) -> DataFrame:
    """The records, and quarantined gaps, of archives given as rows (path, content)."""
    return files.select("path", "content").mapInPandas(_reader(bodies), RECORDS)


def _writer(folder: str) -> object:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))
        out = name = None
        room = count = 0

        def close() -> pd.DataFrame:
            out.close()
            final = f"{uuid.uuid4().hex}.warc.gz"
            store.move(f"{base}/{name}", f"{base}/{final}")
            return pd.DataFrame({"file": [final], "records": [count]})

        for batch in batches:
            for page_id, url, html, refers_to, revisit in batch[["page_id", "url", "html", "refers_to", "revisit"]].itertuples(index=False):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, room, count = f"_{uuid.uuid4().hex}.part", FILE_BYTES, 0
                    out = store.open_output_stream(f"{base}/{name}")
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                data = member(record(page_id, url, (html or "").encode("utf-8", "replace"), refers_to, bool(revisit), uuid.uuid4().hex))
                out.write(data)
                room, count = room - len(data), count + 1
                if room <= 0:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html with refers_to and revisit: repeats of a payload refer to its smallest page_id."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    same = pages.select("page_id", F.sha1("html").alias("same"), F.octet_length("html").alias("size")).where(F.col("size") >= least)
    first = written(same.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").select("same", "first"), "first")
    if not first.limit(1).count():
        return pages.withColumns({"refers_to": F.lit(None).cast("long"), "revisit": F.lit(False)})
    # Payloads that are too small to be shared have keys of their own, so that they meet nothing and not each other.
    key = F.when(F.octet_length("html") >= least, F.sha1("html")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    out = spread(pages.withColumn("same", key), first, "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to archives under ``folder``; returns the written files as a table (file, records)."""
    starts(pages.sparkSession)
    return written(marked(pages, least).mapInPandas(_writer(folder), "file string, records long"), "manifest")


def written_files(manifest: DataFrame, folder: str) -> DataFrame:
    """The archives of a manifest, as rows (path, content); other files in the folder are left out."""
    spark = manifest.sparkSession
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return found.withColumn("file", F.substring_index("path", "/", -1)).join(small(manifest.select("file")), "file", "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = written(read_warc(written_files(manifest, folder), bodies=False), "records")
    wrote, (read, gaps) = manifest.agg(F.sum("records")).first()[0], records.agg(F.count_if(F.col("kind") != "quarantine"), F.count_if(F.col("kind") == "quarantine")).first()
    if gaps or read != wrote:
        raise RuntimeError(f"{wrote} records were written, {read} read, with {gaps} gaps")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
