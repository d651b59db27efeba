"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Tasks write archives of bounded size to a folder that all share and return a manifest of the finished ones;
what a failed or repeated task left behind is in no manifest and never read. Tasks read one archive each, as
a stream of frames: a task holds one record and one small chunk. Folders are reached through
``pyarrow.fs``, by their URI.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from uuid import UUID, uuid4

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import require, saved
from tabsmith.operators.lookup import spread_lookup

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
LEVEL = 3
HOT_ROWS = 256
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = ("archive string, offset long, page_id long, url string, record_type string, refers_to long, "
          "payload_bytes long, payload_digest string, error string")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:uuid:{UUID(int=1 << 127 if page_id is None else page_id % (1 << 64))}>"


def page_of(text: str) -> int | None:
    value = UUID(text.removeprefix("<urn:uuid:").removesuffix(">")).int
    return None if value >= 1 << 64 else value - (1 << 64) if value >= 1 << 63 else value


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 response, or a revisit without the payload but with its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    found = {}
    for line in raw.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line {line[:60]!r}")
        found[name.lower()] = value.strip()
    return found


def parse(raw: bytes) -> tuple[dict, bytes]:
    """What ``RECORD`` has of a record, and its payload; raises ValueError where headers or lengths are wrong."""
    version, _, rest = raw.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"version {version[:20]!r}")
    head, gap, rest = rest.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("headers don't end")
    fields = _headers(head)
    if missing := [m for m in MANDATORY if m.lower() not in fields]:
        raise ValueError(f"no {missing[0]}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {fields['content-length'][:20]} of a block of {len(rest) - 4} bytes")
    kind = fields["warc-type"]
    out = {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
           "refers_to": None, "payload_bytes": None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    if kind not in ("response", "revisit"):
        return out, b""
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP headers")
    length = _headers(lines).get("content-length", "")
    if not length.isdigit():
        raise ValueError("no HTTP Content-Length")
    out["payload_bytes"] = int(length)
    if kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise ValueError("a revisit has no payload and refers to a record")
        out["refers_to"] = page_of(fields["warc-refers-to"])
    elif len(payload) != out["payload_bytes"]:
        raise ValueError(f"HTTP Content-Length {length} of a payload of {len(payload)} bytes")
    elif digest(payload) != out["payload_digest"]:
        raise ValueError("payload digest")
    return out, payload


def dictionary(samples: list[bytes]) -> bytes:
    """Trained where there is enough to train on, else the samples' end as a plain-content dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Archive:
    """Writes one archive: the dictionary frame, then a frame per record."""

    def __init__(self, folder: str, samples: list[bytes]):
        self.path = f"{folder}/{uuid4().hex}.warc.zst"
        system, local = fs.FileSystem.from_uri(self.path)
        system.create_dir(local.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(local, compression=None)
        content = dictionary(samples)
        shared = zstandard.ZstdCompressionDict(content)
        shared.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(content)
        self.records = self.bytes = 0
        self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.compressor.compress(raw))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def _rolled(records: Iterator[bytes], folder: str, most_bytes: int) -> Iterator[tuple[str, int, int]]:
    """Archives of at most ``most_bytes`` and a record; each one's dictionary comes from its first records."""
    waiting: list[bytes] = []
    archive, size = None, 0
    for raw in records:
        if archive is None:
            waiting.append(raw)
            size += len(raw)
            if size < SAMPLE_BYTES:
                continue
            archive = Archive(folder, waiting)
            for w in waiting:
                archive.add(w)
            waiting, size = [], 0
        else:
            archive.add(raw)
        if archive.bytes >= most_bytes:
            yield archive.close()
            archive = None
    if waiting:
        archive = Archive(folder, waiting)
        for w in waiting:
            archive.add(w)
    if archive is not None:
        yield archive.close()


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds ``_first``: for a payload that occurs in several rows, the smallest page_id that has it.

    Digests are counted before they are shuffled; rows of a payload with many copies are dealt over tasks.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload)).alias("_sha"))
    groups = keyed.select("page_id", "_sha").groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = saved(groups.filter("_n > 1").drop("_n"))
    return spread_lookup(keyed, copies, ["_sha"], ["page_id", "url"], "left", HOT_ROWS).drop("_sha")


def write_archives(pages: DataFrame, folder: str, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, html as WARC records under ``folder``; gives the manifest, a row per archive.

    The record with the smallest page_id of those with one payload (null: empty) is the response, the others
    revisit it. Rows that repeat that page_id are responses too; a null page_id is only a response where its
    payload has no other. Line breaks in a URL are percent-encoded, a null URL is left out. Other columns are
    ignored. An empty table gives an empty manifest.
    """
    require(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def raws() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "_first")), strict=True):
                    yield record(page_id, url, html.encode(), first, first is not None and first != page_id)

        for path, n, size in _rolled(raws(), folder, most_bytes):
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return saved(with_revisits(pages).mapInArrow(run, MANIFEST))


def frames(stream, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame. The dictionary is that of the leading skippable frame; other such frames are skipped."""
    data, at, shared = b"", 0, None

    def fill(least: int) -> bool:
        nonlocal data
        while len(data) < least and (more := stream.read(max(chunk, least - len(data)))):
            data += more
        return len(data) >= least

    while fill(1):
        if not fill(8):
            raise ValueError("a frame ends early")
        if int.from_bytes(data[:4], "little") in SKIPPABLE:
            size = int.from_bytes(data[4:8], "little")
            if not fill(8 + size):
                raise ValueError("a skippable frame ends early")
            if at == 0 and int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
                content = data[8 : 8 + size]
                if content[:4] == FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompress(content)
                shared = zstandard.ZstdCompressionDict(content)
            data, at = data[8 + size :], at + 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        parts, used = [], 0
        while not decoder.eof:
            if not fill(1):
                raise ValueError("a frame ends early")
            parts.append(decoder.decompress(data))
            used += len(data)
            data = decoder.unused_data if decoder.eof else b""
        used -= len(data)
        yield at, b"".join(parts)
        at += used


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """``RECORD`` (and ``payload``, binary) for every record of the archives in column ``path``.

    A record whose headers or lengths are wrong gives a row with the reason in ``error``; a broken frame gives
    one for the rest of its archive, which can't be found without it.
    """
    require(manifest, "path")
    names = [part.split()[0] for part in RECORD.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, size = [], 0
                for row in read_one(path):
                    rows.append(row)
                    size += len(row["payload"] or b"") if with_payload else 100
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    types = {"offset": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def read_one(path: str) -> Iterator[dict]:
        system, local = fs.FileSystem.from_uri(path)
        with system.open_input_stream(local, compression=None) as stream:
            at = None
            try:
                for at, raw in frames(stream):
                    row = dict.fromkeys(names) | {"archive": path, "offset": at}
                    try:
                        found, row["payload"] = parse(raw)
                        row |= found
                    except ValueError as e:
                        row |= {"error": str(e), "payload": None}
                    yield row
            except (ValueError, zstandard.ZstdError) as e:
                yield dict.fromkeys(names) | {"archive": path, "offset": at, "error": str(e), "payload": None}

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))
