"""WARC archives: a writer and a sequential reader.

Every task writes archives of bounded size to a shared folder, one gzip member a record,
under names that no other attempt uses; a manifest lists the files that count. The reader
streams an archive: incremental zlib decompression member by member, framing by content
length, digests verified. Of records with equal payloads one is a response and the others
revisit it; the payload's digest decides, and payloads aren't moved to find out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import new_path, written

#: Bytes after which an archive is closed, and of a read.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Payloads under this many bytes are never revisits.
LEAST_REVISIT = 1000
#: Recurring digests up to this number (50 bytes each) are broadcast.
BROADCAST_DIGESTS = 200_000
#: Rows of a batch between Spark and Python while payloads are carried.
BATCH_BYTES = 16 << 20

# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_header(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(url.split()),
        "WARC-Payload-Digest": digest_header(payload),
        "WARC-Block-Digest": digest_header(block),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    data = f"{VERSION}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Members:
    """Bytes of one gzip member after another, decompressed as they are asked for."""

    def __init__(self, stream, read: int = READ_BYTES):
        self.stream, self.step, self.rest = stream, read, b""

    def next(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.stream.read(self.step)
        self.inflate, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.rest)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self.stream.read(self.step)
            if not self.rest:
                raise ValueError("an archive ends within a record")
        self.out += self.inflate.decompress(self.rest, self.step)
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (k := self.out.find(mark)) < 0:
            if not self._more():
                raise ValueError("a header without an end")
        taken = bytes(self.out[:k])
        del self.out[: k + len(mark)]
        return taken

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("a record shorter than its content length")
        taken = bytes(self.out[:n])
        del self.out[:n]
        return taken

    def ends(self) -> None:
        while self._more():
            pass
        if bytes(self.out) != b"\r\n\r\n":
            raise ValueError("a record longer than its content length")


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "surrogatepass").split("\r\n"))}


def read_records(stream) -> Iterator[dict]:
    """Records of one archive, in order: page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest (hex). Raises ValueError on damage."""
    members = Members(stream)
    while members.next():
        version, _, lines = members.until(b"\r\n\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = _fields(lines)
        block = members.exactly(int(head["content-length"]))
        members.ends()
        if digest_header(block) != head["warc-block-digest"]:
            raise ValueError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(_fields(http.partition(b"\r\n")[2])["content-length"])
        revisit = head["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or digest_header(payload) != head["warc-payload-digest"]):
            raise ValueError("payload digest differs")
        of = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
        yield {
            "page_id": of(head["warc-record-id"]),
            "url": head["warc-target-uri"],
            "record_type": head["warc-type"],
            "refers_to": of(head["warc-refers-to"]) if revisit else None,
            "payload": None if revisit else payload,
            "payload_bytes": size,
            "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(),
        }


def with_revisits(df: DataFrame, page_id: str = "page_id", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url if any, payload, refers_to: the largest page_id of an equal payload of `least` bytes or more, null for that record itself and for all others.

    Rows equal in id and payload are all responses; a null page_id never is referred to. Which payloads recur is
    decided on digests alone. Up to BROADCAST_DIGESTS of them are broadcast and payloads stay in place; beyond
    that, only digests with many records are, at most four for each partition, and the others are joined by digest.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    url = F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in df.columns else F.lit("")
    same = F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))).alias("same")
    rows = df.select(F.col(page_id).alias("page_id"), url.alias("url"), payload.alias("payload"))
    long = rows.select("page_id", same).where("same is not null")
    first = written(long.groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "digests")
    n_first, n_records = first.agg(F.count("*"), F.sum("n")).first()
    keyed = rows.select("*", same)
    if n_first <= BROADCAST_DIGESTS:
        joined = keyed.join(F.broadcast(first), "same", "left")
    else:
        hot = F.col("n") > max(1, n_records // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        known = keyed.join(F.broadcast(first.where(hot)), "same", "left")
        # Short payloads have no digest; of the others, those that no broadcast digest has told are joined by digest.
        rest = known.where("first is null and same is not null").drop("first", "n")
        told = known.where("first is not null or same is null")
        joined = told.unionByName(rest.join(first.where(~hot).hint("shuffle_merge"), "same", "left"))
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(df: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, payload, refers_to as archives in folder (a URI); returns the manifest: path, n_records, n_bytes.

    A task that fails or runs twice leaves files that no manifest names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": n, "n_bytes": size}], pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for b in batches:
            for page, url, payload, refers in zip(*(c for c in b.columns)):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page, refers = page.as_py(), refers.as_py()
                data = record_bytes("" if page is None else str(page), url.as_py(), payload.as_buffer().to_pybytes(), None if refers is None else str(refers))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(df.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records bigint, n_bytes bigint"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest names, file by file."""
    names = ["page_id", "url", "record_type", "refers_to", *(["payload"] if payloads else []), "payload_bytes", "payload_digest"]
    kinds = {"payload": (pa.binary(), "binary"), "payload_bytes": (pa.int64(), "bigint")}
    schema = pa.schema([(c, kinds.get(c, (pa.string(),))[0]) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, size = [], 0
                    for r in read_records(stream):
                        rows.append({c: r[c] for c in names})
                        size += len(r["payload"] or b"") * payloads + 200
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(run, ", ".join(f"{c} {kinds.get(c, (0, 'string'))[1]}" for c in names))


def archived(df: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Writes a record per row to the shared folder, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Repeated rows give a record each; no rows give none.
    """
    spark: SparkSession = df.sparkSession
    kind = df.schema[page_id].dataType
    read = read_archives(write_archives(with_revisits(df, page_id, html), new_path(spark, "warc")), payloads=False)
    of = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind).alias(c)
    return read.select(of("page_id"), "payload_bytes", "payload_digest", "record_type", of("refers_to"))
