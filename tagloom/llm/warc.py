"""WARC archives written from and read into a chunked record table.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, so neither the
writer nor the reader holds a whole record: the writer compresses chunk after chunk into the
record's own gzip member, the reader inflates, parses and emits chunk after chunk.  Every row read
carries the SHA-1 of the payload up to its end (the incremental digest); the last row's is the
payload's and is checked against the header.

Archives go to the caller's folder, or to one below ``spark.checkpoint.dir``, through ``pyarrow.fs``:
any file system that pyarrow opens by URI.  Hadoop's names for S3 (``s3a``, ``s3n``) are opened as
``s3``, with the credentials that pyarrow finds (environment, profile or instance role; settings of
Hadoop's own such as ``fs.s3a.access.key`` are not read).  A task writes files under names of its own and reports
them in the manifest; only files that a finished task reported are ever read, so a repeated task
leaves at most an unread file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import materialize, scratch_path

CHUNK = 1 << 18
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


# --- folders -----------------------------------------------------------------------------

def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and host that Spark gives it, so that every task means the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.toUri().getScheme():
        return folder
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(folder: str):
    """(pyarrow file system, path in it) of a folder; without a scheme it is a local one."""
    from pyarrow import fs
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", folder) or folder.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", folder)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


# --- records -----------------------------------------------------------------------------

def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, refers_to): one row per page, null html as empty.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the largest
    page_id is the response (refers_to null) and the others refer to it.  Rows that repeat the
    largest page_id too are responses each; rows without an id never are what others refer to.
    Only the digests with copies are joined back; a hot digest is combined in each task first
    and its rows are a skewed join side, which Spark splits.
    """
    src = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("digest"))
    copies = (src.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep"))
    copies = materialize(copies, "warc-copies")
    return src.join(copies, "digest", "left").select(
        "page_id", "url", "payload", "n_bytes", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def chunks(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: ``recs`` with (chunk, n_chunks, data) in place of the payload.

    The chunks of a record are consecutive rows in order; a revisit has one empty chunk.
    """
    size = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int")
    rows = recs.withColumn("n_chunks", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "n_bytes", "digest", "refers_to", "n_chunks", "chunk",
                       F.coalesce(data, F.lit(b"")).alias("data"))


# --- writing -----------------------------------------------------------------------------

def record_name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def head(page_id, url, n_bytes: int, digest: str, refers_to) -> bytes:
    """WARC and HTTP header of a record; the payload, if any, follows."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n").encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{base32(digest)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (n_bytes if refers_to is None else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


def write(table: DataFrame, folder: str) -> DataFrame:
    """Write the chunked record table into gzip archives; returns the manifest (path, records, bytes)."""
    def run(batches):
        files, where = file_system(folder)
        files.create_dir(where, recursive=True)
        out, packer, path, done, size = None, None, None, 0, 0

        def manifest():
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([done], pa.int64()), pa.array([size], pa.int64())],
                                              names=["path", "records", "bytes"])

        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in col.items()}
                if row["chunk"] == 0:
                    if out is None:
                        path, done, size = f"{where}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(path, compression=None)
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    got = packer.compress(head(row["page_id"], row["url"], row["n_bytes"], row["digest"], row["refers_to"]))
                else:
                    got = b""
                got += packer.compress(row["data"])
                if row["chunk"] == row["n_chunks"] - 1:
                    got += packer.compress(b"\r\n\r\n") + packer.flush()
                    done += 1
                out.write(got)
                size += len(got)
                if row["chunk"] == row["n_chunks"] - 1 and size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield manifest()
        if out is not None:
            out.close()
            yield manifest()

    return table.mapInArrow(run, "path string, records long, bytes long")


# --- reading -----------------------------------------------------------------------------

class _Inflated:
    """Bytes of consecutive gzip members, a bounded piece at a time."""

    def __init__(self, source, piece: int = 1 << 16):
        self.source, self.piece, self.raw, self.buf = source, piece, b"", b""
        self.unpack = zlib.decompressobj(31)

    def fill(self) -> bool:
        """Add some bytes to ``buf``; False at the end of the archive."""
        while True:
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.piece)
                if not self.raw:
                    return False
            got = self.unpack.decompress(self.raw, self.piece)
            self.raw = b"" if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buf.find(mark)) < 0:
            if not self.fill():
                if self.buf:
                    raise ValueError("archive ends inside a record")
                return None
        out, self.buf = self.buf[:at], self.buf[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        while not self.buf:
            if not self.fill():
                raise ValueError("archive ends inside a record")
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def parse(source, chunk: int = CHUNK):
    """Rows (page_id, type, refers_to, digest, n_bytes, chunk, data, so_far, last) of one archive."""
    stream = _Inflated(source)
    while (block := stream.until(b"\r\n\r\n")) is not None:
        warc = _fields(block.lstrip(b"\r\n"))
        http = stream.until(b"\r\n\r\n")
        left = int(warc["content-length"]) - len(http) - 4
        n_bytes, sha, no = int(_fields(http)["content-length"]), hashlib.sha1(), 0
        want = warc["warc-payload-digest"].removeprefix("sha1:")
        page, kind, refers = _page(warc["warc-record-id"]), warc["warc-type"], _page(warc.get("warc-refers-to"))
        if kind == "response" and left != n_bytes:
            raise ValueError(f"page {page}: {left} bytes of payload, {n_bytes} declared")
        while True:
            data = b""
            while left and len(data) < chunk:
                got = stream.take(min(left, chunk - len(data)))
                left -= len(got)
                data += got
            sha.update(data)
            so_far = base32(sha.hexdigest())
            if not left and kind == "response" and so_far != want:
                raise ValueError(f"page {page}: payload digest {so_far}, {want} declared")
            yield page, kind, refers, want, n_bytes, no, data, so_far, not left
            if not left:
                break
            no += 1
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError(f"page {page}: record is longer than declared")


ROW = ("page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, "
       "chunk int, data binary, digest_so_far string, last boolean")


def read(manifest: DataFrame, folder: str, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives in the manifest (``ROW``).

    Without ``payload`` the chunks are still read, digested and checked, but only each record's
    last row is returned, without data.
    """
    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk", pa.int32()),
                       ("data", pa.binary()), ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def run(batches):
        files, _ = file_system(folder)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(path, compression=None) as source:
                    for row in parse(source, chunk):
                        if payload or row[8]:
                            rows.append(row if payload else (*row[:6], None, *row[7:]))
                            held += 200 + (len(row[6]) if payload else 0)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, ROW)


def archive(pages: DataFrame, min_revisit_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write one record per row of ``pages`` (page_id, url, html); returns the manifest and the archives' folder.

    With ``folder`` the archives are kept in ``folder/warc`` and their manifest in ``folder/manifest``, which
    must not exist yet (it raises before anything is written); ``open_archive`` finds both again.  Without, the
    archives lie below ``spark.checkpoint.dir`` and the manifest goes when the process ends.
    Other columns are not read.  An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    table = chunks(records(pages, min_revisit_bytes))
    if folder is None:
        target = qualified(spark, scratch_path(spark, "warc"))
        return materialize(write(table, target), "warc-manifest"), target
    write(table, qualified(spark, f"{folder}/warc")).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return open_archive(spark, folder)


def open_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The manifest and the archives' folder of what ``archive`` wrote to ``folder``, as ``read`` takes them."""
    return spark.read.parquet(f"{folder}/manifest"), qualified(spark, f"{folder}/warc")
