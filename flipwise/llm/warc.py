"""WARC archives as seekable Zstandard bundles.

A bundle is a plain ``.warc.zst`` file: records are grouped into independent
Zstandard frames, a skippable frame holds the map from record identifier to
(frame, offset inside the frame, length), and the Zstandard seek table (its
public seekable format) comes last.  Any Zstandard tool unpacks the bundle to
a plain WARC file; a reader that knows the tables fetches one record by
unpacking one frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, open_folder, runs, scratch_folder, stored, whole_text, write_atomically

FRAME_BYTES = 1 << 20
#: A task begins another bundle once one holds this many bytes of records, so its record map stays small.
BUNDLE_BYTES = 256 << 20
LEVEL = 3
#: Fixed values of the Zstandard formats.
SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Fixed values of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 40 hex digits in groups of 5 give 4 letters each."""
    digest = F.sha1(text)
    letters = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_record_types(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to.

    Of equal payloads of at least ``least_bytes`` bytes, the largest id is the
    response and the others revisit it.  Payloads are grouped by digest and
    length with a map-side aggregation; only groups of two or more are joined
    back, on narrow rows when they are few.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        whole_text(html_col).alias("html"))
    rows = rows.withColumns({"digest": base32_of_sha1(F.col("html")), "n_bytes": F.octet_length("html").cast("long")})
    groups = rows.select("page_id", "digest", "n_bytes").where(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes") \
        .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies") \
        .withColumn("grouped", F.lit(True))
    revisit = F.col("grouped") & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(groups, ["digest", "n_bytes"], "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("winner")).alias("refers_to"))


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(identifier: str, kind: str, date: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


def bundle_chunks(records: Iterator[tuple[str, bytes]], frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> Iterator[bytes]:
    """The bytes of a bundle: frames, record map, seek table."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
    table: list[tuple[int, int]] = []
    where: dict[str, list] = {"id": [], "frame": [], "offset": [], "length": []}
    held, n = [], 0

    def frame() -> bytes:
        out = packer.compress(b"".join(held))
        table.append((len(out), n))
        return out

    for identifier, data in records:
        if held and n + len(data) > frame_bytes:
            yield frame()
            held, n = [], 0
        for k, v in zip(where, (identifier, len(table), n, len(data))):
            where[k].append(v)
        held.append(data)
        n += len(data)
    if held:
        yield frame()
    body = packer.compress(json.dumps(where).encode())
    yield struct.pack("<II", SKIPPABLE_MAP, len(body)) + body
    table.append((len(body) + 8, 0))
    entries = b"".join(struct.pack("<II", *t) for t in table) + struct.pack("<IBI", len(table), 0, SEEKABLE_MAGIC)
    yield struct.pack("<II", SKIPPABLE_SEEK, len(entries)) + entries


class Bundle:
    """Reader of one bundle: tables in memory, one frame unpacked at a time."""

    def __init__(self, folder: str, name: str):
        filesystem, path = open_folder(folder)
        self.file = filesystem.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table = list(struct.iter_unpack("<II", self._at(size - 9 - 8 * n, 8 * n)))
        self.frames, at = [], 0
        for packed, unpacked in table:
            self.frames.append((at, packed, unpacked))
            at += packed
        begin, packed, _ = self.frames.pop()
        where = json.loads(zstandard.ZstdDecompressor().decompress(self._at(begin + 8, packed - 8)))
        self.records = list(zip(where["id"], where["frame"], where["offset"], where["length"]))
        self.by_id: dict[str, list[tuple[int, int, int]]] = {}
        for identifier, *place in self.records:
            self.by_id.setdefault(identifier, []).append(tuple(place))

    def _at(self, begin: int, n: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(n)

    def frame(self, number: int) -> bytes:
        begin, packed, unpacked = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self._at(begin, packed), max_output_size=unpacked)

    def fetch(self, identifier: str) -> list[bytes]:
        """The records of an identifier (several if its page was given several times)."""
        return [self.frame(f)[o:o + n] for f, o, n in self.by_id.get(identifier, ())]

    def __iter__(self) -> Iterator[tuple[str, bytes]]:
        number, data = -1, b""
        for identifier, f, o, n in self.records:
            if f != number:
                number, data = f, self.frame(f)
            yield identifier, data[o:o + n]

    def close(self) -> None:
        self.file.close()


def page_identifier(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def page_of(identifier: str) -> int | None:
    value = identifier.strip("<>").removeprefix("urn:page:")
    return None if value == "none" else int(value)


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles that end once their records reach ``bundle_bytes``, one or more per task; returns the manifest (file, records).

    Null payloads count as empty, a null url is left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    name = page_identifier(page)
                    yield name, record_bytes(name, kind, date, url, html.encode(), digest,
                                             page_identifier(refers) if kind == "revisit" else None)

        task = TaskContext.get()
        n = 0

        def size(record: tuple[str, bytes]) -> int:
            nonlocal n
            n += 1
            return len(record[1])

        for part, run in enumerate(runs(records(), size, bundle_bytes)):
            n = 0
            name = f"part-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.warc.zst"
            write_atomically(folder, name, bundle_chunks(run, frame_bytes))
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    typed = with_record_types(pages, id_col, url_col, html_col, least_bytes)
    return stored(arrow_map(typed, write, "file string, records long"), "warc-manifest")


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Length and digest of a response come from its payload, and must agree
    with its headers; a revisit has no payload, so its headers tell them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                bundle = Bundle(folder, name)
                for identifier, data in bundle:
                    head, block = parse_record(data)
                    digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    refers = None
                    if head["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (own, len(payload)) != (digest, length):
                            raise ValueError(f"{name}: payload of {identifier} differs from its headers")
                    else:
                        refers = page_of(head["warc-refers-to"])
                    rows.append((page_of(head["warc-record-id"]), length, digest, head["warc-type"], refers, head.get("warc-target-uri")))
                bundle.close()
                for a in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[a:a + 10_000]))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                     ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    files = manifest.select("file")
    return arrow_map(files.repartition(max(1, files.count()), "file"), read,
                     "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """Write the bundles of ``pages`` and read them back, one row per page.

    Repeated rows are records of their own; all rows that repeat the winning
    id of a group are responses; if all ids of a group are null, so is the
    winner's and every row is a response.  Other columns are not read; an empty
    table gives no rows and no bundle.
    """
    folder = folder or scratch_folder(spark, "warc")
    return read_bundles(write_bundles(pages, folder, **kw), folder)
