"""WARC archives in Zstandard frames, written and read with a dictionary (operator 2).

An archive is a sequence of frames: first a skippable one that holds the
dictionary, then one frame for each record.  Spark's text writer writes them,
so archives go to any file system that Spark knows and a lost task leaves no
half archive; its line separator is an empty skippable frame, which readers
pass over like any other.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path

# Fixed values of the formats.
MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode()
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DIGESTS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}
#: Headers that a record may have more than once.
REPEATED = ("warc-concurrent-to",)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Payloads from this size on are written once and revisited.
MIN_REVISIT = 1000
#: The dictionary is trained on so many payloads at most, each cut to so many bytes, and has at most so many bytes.
DICT_ROWS, DICT_CUT, DICT_BYTES = 400, 16_384, 32_768
#: Bytes after which an archive is closed.
ROLL = 1 << 25
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"


class ArchiveError(ValueError):
    pass


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where there is too little to train on."""
    samples = [s for s in samples if len(s) >= 64]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICT_BYTES:
        return b""
    return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY, len(data)) + data


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: int | None, full: int, place: str = "") -> bytes:
    """A record's bytes.  A revisit has no block; its digest and X-Payload-Length speak of the full payload."""
    block = HTTP_HEAD + payload if kind == "response" else b""
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _name(page_id, place)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("WARC-Payload-Digest", sha),
        ("X-Payload-Length", str(full)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + b"\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None, place: str = "") -> str:
    """A record's name: its page, and its place in the write unless it is what revisits refer to."""
    return f"<urn:page:{'none' if page_id is None else page_id}{':' if place else ''}{place}>"


def _page(name: str | None) -> int | None:
    """The page that a record of this module's archives is named after; null for any other name."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)(:[0-9]+-[0-9]+)?>", name or "")
    return int(found[1]) if found else None


def _hex(digest: str | None) -> tuple[str | None, str | None]:
    """Algorithm and hex digits of a labelled digest in base 32 or 16; nulls where it can't be read."""
    kind, colon, value = (digest or "").partition(":")
    kind = kind.lower().replace("-", "")
    if not colon or kind not in DIGESTS:
        return None, None
    size = DIGESTS[kind]().digest_size
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None, None
    return (kind, raw.hex()) if len(raw) == size else (None, None)


def _unchunked(body: bytes) -> bytes:
    """A body in chunks put together; as it is where it has none."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return body


def payload(headers: dict[str, str], block: bytes) -> bytes:
    """What a record is about: an HTTP message's body, else the block.

    Raises ArchiveError if neither the body nor its chunks put together has
    the digest that the record gives.
    """
    http = headers.get("content-type", "").lower().startswith("application/http")
    end = block.find(b"\r\n\r\n") if http else -4
    head, body = block[: max(end, 0)], block[end + 4 :] if end >= 0 or not http else b""
    kind, want = _hex(headers.get("warc-payload-digest"))
    chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head)
    if headers["warc-type"] == "revisit" or kind is None:
        return _unchunked(body) if chunked else body
    for found in (body, _unchunked(body)) if chunked else (body,):
        if DIGESTS[kind](found).hexdigest() == want:
            return _unchunked(body) if chunked else body
    raise ArchiveError("the payload doesn't have its digest")


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the frame that starts at ``at``, by its header and block headers."""
    if len(data) - at < 5:
        raise ArchiveError(f"truncated frame at {at}")
    magic = struct.unpack_from("<I", data, at)[0]
    if magic in SKIPPABLE:
        size = 8 + struct.unpack_from("<I", data, at + 4)[0] if len(data) - at >= 8 else len(data)
    elif magic == MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        size = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            if at + size + 3 > len(data):
                raise ArchiveError(f"truncated frame at {at}")
            head = int.from_bytes(data[at + size : at + size + 3], "little")
            size += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        size += 4 * (flags >> 2 & 1)
    else:
        raise ArchiveError(f"no frame at {at}")
    if at + size > len(data):
        raise ArchiveError(f"truncated frame at {at}")
    return size


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and block of one record of version 1.0 or 1.1, which must fill ``raw``."""
    end, first = raw.find(b"\r\n\r\n"), raw[:10].partition(b"\r\n")
    if end < 0 or first[0] not in VERSIONS or not first[1]:
        raise ArchiveError("no WARC record")
    headers: dict[str, str] = {}
    key = ""
    for line in raw[10:end].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and key:  # goes on
            headers[key] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        key = name.strip().lower()
        if not colon or not key:
            raise ArchiveError(f"bad header line {line[:40]!r}")
        if key in headers and key not in REPEATED:
            raise ArchiveError(f"header {key} occurs twice")
        headers[key] = f"{headers[key]}, {value.strip()}" if key in headers else value.strip()
    if missing := [k for k in REQUIRED if k.lower() not in headers]:
        raise ArchiveError(f"no header {missing[0]}")
    if not re.fullmatch("[0-9]+", headers["content-length"]):
        raise ArchiveError("bad Content-Length")
    block = raw[end + 4 : -4]
    if raw[-4:] != b"\r\n\r\n" or len(raw) - end - 8 != int(headers["content-length"]):
        raise ArchiveError("Content-Length is not the block's")
    return headers, block


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of the records of an archive, each from a frame of its own.

    Raises ArchiveError for a bad frame, a dictionary that isn't first, a frame
    with another number of records than one, bad headers or lengths, and a
    payload that doesn't have its digest.
    """
    view, at, first = memoryview(data), 0, True
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        size = frame_size(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY:
            if not first:
                raise ArchiveError("the dictionary frame isn't first")
            known = bytes(view[at + 8 : at + size])
            if known[:4] == struct.pack("<I", MAGIC):
                known = zstandard.ZstdDecompressor().decompress(known)
            if known:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
        elif magic == MAGIC:
            try:
                raw = reader.decompressobj().decompress(view[at : at + size])
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame at {at}: {e}") from e
            headers, block = parse(raw)
            yield headers, payload(headers, block)
        at += size
        first = False


def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to, named) for each row of pages; named tells what revisits refer to.

    Of equal payloads of MIN_REVISIT bytes or more the one with the largest
    page_id is the response; rows without page_id come after all others, and
    rows that share the largest are all responses.  Only digests that occur
    more than once are joined, so payloads that are alone have no partner to
    wait for; a row that can't be a revisit gets a key of its own, so no key
    gathers them.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    big = F.length("payload") >= MIN_REVISIT
    heads = base.where(big).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("head")).where("n > 1 and head is not null")
    heads = cut(heads.select(F.col("digest").alias("key"), "head"), "heads")
    keyed = base.withColumn("key", F.when(big, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    kind = F.when(F.col("head").isNull() | F.col("page_id").eqNullSafe(F.col("head")), "response").otherwise("revisit")
    out = keyed.join(heads, "key", "left").withColumn("kind", kind).withColumn("named", F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull())
    return out.withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("head"))).drop("key", "head")


def write(decided: DataFrame, path: str, dictionary: bytes, roll: int = ROLL) -> None:
    """Writes archives of decide()'s rows, each a file that begins with the dictionary and ends with the record that brings it to ``roll`` bytes.

    However the rows are dealt out, no archive is longer than that and a record,
    so a payload with very many copies fills many archives.  Records are named
    after their page and, but for what revisits refer to, their place, so only
    rows that agree in id and payload may share a name.
    """
    shared = decided.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        known, task, n = shared.value, TaskContext.get().partitionId(), 0
        kwargs = {"dict_data": zstandard.ZstdCompressionDict(known)} if known else {}
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **kwargs).compress
        frames, size = [dictionary_frame(known)], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page_id, url, payload, digest, kind, refers_to, named in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    frames.append(compress(record(page_id, url, payload, kind, digest, refers_to, len(payload), "" if named else f"{task}-{n}")))
                    n, size = n + 1, size + len(frames[-1])
                    if size >= roll:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], ["archive"])
                        frames, size = [dictionary_frame(known)], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], ["archive"])

    rows = decided.select("page_id", "url", "payload", "digest", "kind", "refers_to", "named")
    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)  # a row is an archive


SCHEMA = "record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, refers_to_id string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below path, of any type and maker: headers, payload and what they say.

    page_id and refers_to are those of archives that write() made, else null;
    record_id and refers_to_id are the names as they stand.  payload_digest is
    bare lower-case hex, of the header where there is one that can be read, else
    the SHA-1 of the payload.  A revisit's payload_bytes are null if it doesn't
    say them; with_lengths() looks them up.  A task holds one archive, which
    Spark can read up to 2 GB; those of write() are far smaller.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                for at in _groups(records(data.as_py())):
                    yield _rows(at)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def _groups(found, rows: int = 256, size: int = 1 << 24):
    group, held = [], 0
    for x in found:
        group.append(x)
        held += len(x[1])
        if len(group) == rows or held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _rows(found) -> pa.RecordBatch:
    rows = []
    for h, body in found:
        kind = h["warc-type"]
        revisit = kind == "revisit"
        told = h.get("x-payload-length", "")
        size = (int(told) if told.isdigit() else None) if revisit else len(body)
        digest = _hex(h.get("warc-payload-digest"))[1] or (None if revisit else hashlib.sha1(body).hexdigest())
        of = h.get("warc-refers-to") if revisit else None
        rows.append((h["warc-record-id"], _page(h["warc-record-id"]), h.get("warc-target-uri") or None, kind, body, size, digest, _page(of), of))
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], [x.split()[0] for x in SCHEMA.split(", ")])


def with_lengths(found: DataFrame) -> DataFrame:
    """read()'s rows with the payload_bytes of revisits that don't say them taken from the record that they name."""
    heads = found.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("payload_bytes").alias("__n"))
    joined = found.join(heads, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "__n"))
    return joined.select(found.columns)


def unresolved(found: DataFrame) -> DataFrame:
    """Revisits that have no response of the same page_id, digest and length; empty for whole archives."""
    heads = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return found.where("record_type = 'revisit'").join(heads, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def training_rows(pages: DataFrame) -> list[bytes]:
    """The starts of the pages that the dictionary is trained on: the first by a hash of page_id, over the whole table."""
    rows = pages.where("html is not null").select(F.xxhash64("page_id").alias("at"), F.xxhash64("html").alias("tie"), F.encode(F.substring("html", 1, DICT_CUT), "utf-8").alias("start"))
    least = rows.select("at", "tie").distinct().orderBy("at", "tie").limit(DICT_ROWS).collect()  # hashes only, as every task sends as many
    if not least:
        return []
    at, tie = least[-1]
    found = rows.where((F.col("at") < at) | ((F.col("at") == at) & (F.col("tie") <= tie))).dropDuplicates(["at", "tie"])
    return [bytes(r.start) for r in sorted(found.collect(), key=lambda r: (r.at, r.tie))]


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes an archive of pages to path (by default to the shared folder) and reads it again.

    Null html is an empty payload, repeated rows are records of their own, null
    ids stay null, an empty table gives no rows, and other columns are not
    looked at.  A page of any size is one record, and archives are closed
    by their bytes (write()).
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(decide(pages), path, train_dictionary(training_rows(pages)))
    return read(spark, path)


def query(pages: DataFrame) -> DataFrame:
    found = cut(round_trip(pages).drop("payload", "url"), "records")
    bad = unresolved(found).limit(1).count()
    if bad:
        raise ArchiveError("a revisit refers to no response")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest AND payload_bytes >= 1000
"""
