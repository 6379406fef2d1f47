"""WARC archives compressed record by record with a shared dictionary.

Layout of an archive (.warc.zst): a skippable frame that holds a Zstandard
dictionary built from the archive's own records, then one frame per record.
Any record can be read alone with the dictionary. Of pages with equal payloads
the one with the largest id is written as a response, the others as revisits
that name it.

Executors write archives under names of their own attempt; the manifest, a
table committed by Spark, names the archives that count. A lost executor thus
leaves at most a file nobody reads. The folder has to be on a file system that
pyarrow opens (local or shared mounts, S3, GCS, HDFS).

Null payloads are empty ones. A null id is below every other id, and pages
with equal payloads and only null ids are all responses; rows with the same
id and payload become the same record. An empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shared_folder, written

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D                      # magic number of the leading skippable frame
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 64 << 20       # an archive that reaches this size is closed and a new one begun
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20         # records a dictionary is built from: the first of the archive, this much of them
SAMPLE_RECORDS = 1000
MAX_READERS = 100_000          # tasks that read archives at most; each then reads several, one after the other
RECORD_DATE = "2000-01-01T00:00:00Z"               # pages carry no time of capture


def roles(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """id, url, payload binary, sha1 (hex), response_id: the id that stands for
    all pages with this payload.

    Counts are combined before the shuffle; the join has one row per payload
    on its right side, so adaptive execution can split a payload that very
    many pages share.
    """
    body = F.encode(F.coalesce(pages[payload].cast("string"), F.lit("")), "UTF-8")
    own = pages.select(pages[id_col].alias("id"), pages[url].cast("string").alias("url"),
                       body.alias("payload"), F.sha1(body).alias("sha1"))
    top = pages.select(pages[id_col].alias("id"), F.sha1(body).alias("sha1")) \
        .groupBy("sha1").agg(F.max("id").alias("response_id"))
    return own.join(top, "sha1", "left")


def record(rid, url: str, payload: bytes, sha1: str, response_id) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    revisit = response_id is not None and rid != response_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>", f"WARC-Date: {RECORD_DATE}",
             "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{response_id}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; where they are too few to train,
    their own last bytes serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class _Archive:
    """One archive being written: holds back the first records until there are
    enough to build the dictionary."""

    def __init__(self, fs, path: str):
        self.fs, self.path = fs, path
        self.first: list[bytes] = []
        self.held = self.records = self.size = 0
        self.out = self.packer = None

    def add(self, data: bytes):
        self.records += 1
        if self.packer is None:
            self.first.append(data)
            self.held += len(data)
            if self.held >= SAMPLE_BYTES or len(self.first) >= SAMPLE_RECORDS:
                self._begin()
        else:
            self._put(self.packer.compress(data))

    def _begin(self):
        import zstandard

        words = dictionary(self.first)
        self.packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(words),
                                               write_content_size=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(words).to_bytes(4, "little") + words)
        for data in self.first:
            self._put(self.packer.compress(data))
        self.first = []

    def _put(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def close(self):
        if self.packer is None:
            self._begin()
        self.out.close()
        return self.path, self.records, self.size


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives; returns the manifest: path (in the folder's file
    system), records, bytes."""

    def run(batches):
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        archive, done = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive = _Archive(fs, f"{base}/{uuid.uuid4().hex}.warc.zst")
                archive.add(record(*row))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"])

    rows = roles(pages, id_col, url, payload).select("id", "url", "payload", "sha1", "response_id")
    return written(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def frames(stream, block: int = 1 << 16):
    """The decompressed records of one archive, read block by block."""
    import zstandard

    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    words = stream.read(int.from_bytes(head[4:], "little"))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest = b""
    while True:
        rest = rest or stream.read(block)
        if not rest:
            return
        one, parts = reader.decompressobj(), []
        while not one.eof:
            data = rest or stream.read(block)
            if not data:
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(data))
            rest = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC header fields, HTTP header, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def read(manifest: DataFrame, folder: str, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, if asked for, payload (null for revisits).
    The payload of every response is checked against its digest."""

    def run(batches):
        fs, _ = _file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        fields, http, payload = parse(data)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: a payload does not match its digest")
                        length = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest,
                                     fields["WARC-Type"], _page(fields.get("WARC-Refers-To", "")),
                                     payload if with_payload and not revisit else None))
                        size += len(payload) if with_payload else 100
                        if size > 8 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    # paths are few bytes each: a stated number of partitions keeps them from being read by one task
    names = manifest.select("path").repartition(min(max(1, manifest.count()), MAX_READERS))
    got = names.mapInArrow(run, "page_id string, url string, payload_bytes bigint, payload_digest string, "
                                "record_type string, refers_to string, payload binary")
    got = got.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
    return got if with_payload else got.drop("payload")


def _page(uri: str) -> str | None:
    return uri.removeprefix("<urn:page:").removesuffix(">") or None


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder, as a URI or absolute path."""
    return shared_folder(spark, "warc")
