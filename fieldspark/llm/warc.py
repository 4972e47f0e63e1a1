"""WARC archives: pages become records in segments, archives become pages again.

A record larger than a segment is written as a first record and continuation records that name it as their origin. On
reading, runs of segments that follow each other in one archive are joined where they are read; what is left is
grouped by origin identifier, ordered by segment number, and accepted only if no number is missing and the lengths add
up to the total that the last segment states. The HTTP message in the joined block is then freed from its chunked
transfer framing and held against its digest.

Archives are gzip files written and read by Spark's text source. The separator given to the reader is the start of a
record, so that a row is about a record; the parser takes rows as a stream of bytes and trusts lengths alone, so a
payload may hold the separator.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.scale import bounded_broadcast

from .tables import slices, store

#: Largest block of one record; longer ones continue in further records.
SEGMENT_BYTES = 32 << 10
#: Payload bytes per chunk of the transfer framing.
CHUNK_BYTES = 8 << 10
#: Records per archive; with the segment size it bounds an archive.
RECORDS_PER_FILE = 2000
#: A stated length beyond this is taken as damage.
MAX_BLOCK = 1 << 30
#: Payload bytes of one batch that leaves the reader.
BATCH_BYTES = 8 << 20
KEY = "X-Record-Key"
REFERS_TO = "X-Refers-To-Key"
EOL = b"\r\n"
GAP = b"\r\n\r\n"
START = b"WARC/1."

RECORD = ("type string, key long, uri string, record_id string, refers_to long, stated_digest string, "
          "payload_bytes long, payload_digest string, payload binary, damage string")
RUN = "origin string, first long, last long, total long, head binary, data binary"
NO_RUN = (None,) * 6


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing

def chunked(body: bytes, size: int) -> bytes:
    """``body`` in chunked transfer framing."""
    out = []
    for k in range(0, len(body), size):
        part = body[k:k + size]
        out += [b"%x" % len(part), EOL, part, EOL]
    return b"".join([*out, b"0", GAP])


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + EOL + block + GAP


def one_line(value: str) -> str:
    """A header value without control characters, which would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def page_records(key, uri, body: bytes, refers_to, date: str, segment: int, chunk: int) -> list[bytes]:
    """The records of one page: a response in segments, or a revisit without payload."""
    kind = "response" if refers_to is None else "revisit"
    own = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest_of(body)}"),
              ("Content-Type", "application/http; msgtype=response")]
    if key is not None:
        fields.append((KEY, str(key)))
    if uri is not None:
        fields.append(("WARC-Target-URI", one_line(uri)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record([*fields, ("WARC-Profile", profile), (REFERS_TO, str(refers_to))], http)]
    block = http + chunked(body, chunk)
    if len(block) <= segment:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", "1")], block[:segment])]
    for number, k in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
        if k + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, block[k:k + segment]))
    return out


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", html: str = "html", min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write one record per page, or several where it needs segments, as gzip archives under ``path``.

    Of pages with equal payloads of at least ``min_bytes``, the one with the largest key is a response, the others are
    revisits that name it; rows that share that largest key and payload are all responses. A null payload is an empty
    one. A null key is smaller than any other and is left out of the record; where all keys of equal payloads are null,
    all are responses. Control characters in a URL are percent-coded, a null URL is left out. Other columns are
    ignored.

    Payloads are not shuffled as long as at most ``scale.BROADCAST_ROWS`` payloads are repeated; beyond, they are
    joined with their representatives by digest.
    """
    rows = pages.select(
        F.col(key).cast("bigint").alias("key"), F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")).alias("body")).withColumn("sha", F.sha1("body"))
    firsts = store(
        rows.filter(F.length("body") >= min_bytes).groupBy("sha").agg(F.max("key").alias("newest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND newest IS NOT NULL").select("sha", "newest"), "warc-repeated")
    judged = rows.join(bounded_broadcast(firsts), "sha", "left").select(
        "key", "uri", "body", F.when(F.col("key").isNull() | (F.col("key") < F.col("newest")), F.col("newest")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 100):
                lines = [r[:-1] for row in zip(*(c.to_pylist() for c in part.columns), strict=True)
                         for r in page_records(*row, date, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["record"])

    judged.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# ---------------------------------------------------------------- reading

class Archive:
    """Cuts the bytes of one archive, given in order, into (headers, raw header, block, damage)."""

    def __init__(self, max_block: int = MAX_BLOCK):
        self.held = bytearray()
        self.max_block = max_block
        self.lost = False  # looking for the next start of a record

    def feed(self, data: bytes, end: bool = False) -> Iterator[tuple[dict, bytes, bytes | None, str | None]]:
        held = self.held
        held += data
        while held:
            if self.lost:
                at = held.find(EOL + START)
                if at < 0:
                    del held[:-len(EOL + START)]
                    if end:
                        held.clear()
                    return
                del held[:at + 2]
                self.lost = False
            if not held.startswith(START[:len(held)]):
                yield {}, b"", None, "not a record"
                self.lost = True
                continue
            stop = held.find(GAP)
            if stop < 0:
                if end:
                    yield {}, b"", None, "cut short"
                    held.clear()
                return
            raw = bytes(held[:stop])
            headers = parse_headers(raw)
            length = headers.get("content-length", "")
            size = int(length) if re.fullmatch("[0-9]{1,18}", length) else -1
            last = stop + len(GAP) + size
            if 0 <= size <= self.max_block:
                if len(held) < last + len(GAP) and not end:
                    return
                if held[last:last + 4] == GAP or end and len(held) >= last and not held[last:].strip(EOL):
                    yield headers, raw, bytes(held[stop + len(GAP):last]), None
                    del held[:last + len(GAP)]
                    continue
            yield headers, raw, None, "wrong length"
            del held[:stop]
            self.lost = True


def parse_headers(raw: bytes) -> dict[str, str]:
    """Names in lower case; the first of equal names counts."""
    out: dict[str, str] = {}
    for line in raw.split(EOL)[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def unchunked(body: bytes) -> bytes | None:
    """The payload inside chunked framing, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(EOL, at)
        if end < 0:
            return None
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;.*)?", body[at:end], re.S)
        if not size:
            return None
        n, at = int(size[1], 16), end + 2
        if n == 0:
            # trailing fields, then an empty line
            return b"".join(out) if body[at:at + 2] == EOL or body.find(GAP, at) >= 0 else None
        if body[at + n:at + n + 2] != EOL:
            return None
        out.append(body[at:at + n])
        at += n + 2


def whole_number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch("-?[0-9]{1,18}", value) else None


def finish(headers: dict, block: bytes | None, damage: str | None, payload_too: bool) -> tuple:
    """The values of RECORD for one whole record."""
    kind = headers.get("warc-type")
    stated = headers.get("warc-payload-digest")
    stated = stated.removeprefix("sha1:") if stated else None
    payload = block
    if block is not None and kind in ("response", "request") and headers.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(GAP)
        http = parse_headers(head)
        if not gap:
            payload, damage = None, "no HTTP header"
        elif http.get("transfer-encoding", "").lower().endswith("chunked"):
            payload = unchunked(payload)
            damage = "broken framing" if payload is None else damage
    if kind == "revisit":
        payload = None
    own = None if payload is None else digest_of(payload)
    if own is not None and stated is not None and kind == "response" and own != stated:
        damage = "wrong digest"
    if damage:
        payload = own = None
    return (kind, whole_number(headers.get(KEY.lower())), headers.get("warc-target-uri"), headers.get("warc-record-id"),
            whole_number(headers.get(REFERS_TO.lower())), stated, None if payload is None else len(payload), own,
            payload if payload_too else None, damage)


class Joiner:
    """Joins segments that follow each other; gives whole records and, where segments are elsewhere, runs."""

    def __init__(self, payload_too: bool):
        self.payload_too = payload_too
        self.run: dict | None = None

    def add(self, headers: dict, raw: bytes, block: bytes | None, damage: str | None) -> Iterator[tuple]:
        number = whole_number(headers.get("warc-segment-number"))
        continued = headers.get("warc-type") == "continuation"
        origin = headers.get("warc-segment-origin-id" if continued else "warc-record-id")
        if block is None or damage or number is None or origin is None or continued != (number != 1):
            if number is not None or continued:
                damage = damage or "bad segment"
            yield from self.flush()
            yield (*finish(headers, block, damage, self.payload_too), *NO_RUN)
            return
        if not (self.run and self.run["origin"] == origin and self.run["last"] + 1 == number):
            yield from self.flush()
            self.run = {"origin": origin, "first": number, "head": None if continued else raw, "parts": [], "total": None}
        self.run["last"] = number
        self.run["parts"].append(block)
        self.run["total"] = whole_number(headers.get("warc-segment-total-length"))
        if self.run["total"] is not None:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        run, self.run = self.run, None
        if not run:
            return
        if run["first"] == 1 and run["total"] is not None:
            yield (*joined([(1, run["last"], run["total"], run["head"], b"".join(run["parts"]))], self.payload_too), *NO_RUN)
        else:
            yield (*(None,) * 10, run["origin"], run["first"], run["last"], run["total"], run["head"], b"".join(run["parts"]))


def joined(runs: list[tuple], payload_too: bool) -> tuple:
    """One record from its runs (first, last, total, raw header, bytes), which come in order of their first number."""
    parts, at, total, head = [], 0, None, None
    for first, last, stated, raw, data in runs:
        if first == at + 1:
            parts.append(data)
            at, total = last, stated
            head = raw if first == 1 else head
        if total is not None:
            break
    headers = parse_headers(head) if head else {}
    if not head or total is None:
        return finish(headers, None, "missing segment", payload_too)
    block = b"".join(parts)
    return finish(headers, block, None if len(block) == total else "wrong total length", payload_too)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


RECORD_FIELDS = [("type", pa.string()), ("key", pa.int64()), ("uri", pa.string()), ("record_id", pa.string()), ("refers_to", pa.int64()),
                 ("stated_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                 ("payload", pa.binary()), ("damage", pa.string())]
RUN_FIELDS = [("origin", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("total", pa.int64()), ("head", pa.binary()),
              ("data", pa.binary())]


def read_archives(spark: SparkSession, path: str, payload: bool = True, max_block: int = MAX_BLOCK) -> DataFrame:
    """The records of all gzip archives under ``path``, segments joined: columns RECORD.

    ``payload_bytes``, ``payload_digest`` and (unless ``payload`` is false) ``payload`` belong to the decoded payload; a
    revisit has none. ``damage`` says why a record has no payload: not a record, cut short, wrong length, bad segment,
    missing segment, wrong total length, no HTTP header, broken framing, wrong digest. Reading goes on at the next record
    start. Of repeated segments one counts. No archive, no rows. An archive is read as a stream, record by record.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(RECORD_FIELDS + RUN_FIELDS)
        rows: list[tuple] = []
        size, current, archive, joiner = 0, None, Archive(max_block), Joiner(payload)

        def rest() -> Iterator[tuple]:
            for found in archive.feed(b"", end=True):
                yield from joiner.add(*found)
            yield from joiner.flush()

        for batch in batches:
            for part in slices(batch, 50):
                for name, piece in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if name != current:
                        rows += rest()
                        current, archive = name, Archive(max_block)
                    else:
                        piece = EOL + START + piece
                    size += len(piece)
                    for found in archive.feed(piece):
                        rows += joiner.add(*found)
                    if rows and size > BATCH_BYTES:
                        yield arrow_rows(rows, schema)
                        rows, size = [], 0
        rows += rest()
        if rows:
            yield arrow_rows(rows, schema)

    pieces = spark.read.schema("value string").option("lineSep", (EOL + START).decode()).option("pathGlobFilter", "*.gz").text(path).select(
        F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("piece"))
    parsed = store(pieces.mapInArrow(parse, f"{RECORD}, {RUN}"), "warc-records")

    @F.arrow_udf("array<struct<" + RECORD.replace(" ", ":").replace(",:", ",") + ">>")
    def join_runs(runs: pa.Array) -> pa.Array:
        names = [n for n, _ in RECORD_FIELDS]
        out = [[dict(zip(names, joined([(r["first"], *r["run"].values()) for r in group], payload), strict=True))] for group in runs.to_pylist()]
        return pa.array(out, pa.list_(pa.struct(RECORD_FIELDS)))

    segments = parsed.filter(F.col("origin").isNotNull()).groupBy("origin", "first").agg(
        F.max(F.struct("last", "total", "head", "data")).alias("run")
    ).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("first", "run"))).alias("runs"))
    columns = [n for n, _ in RECORD_FIELDS]
    return parsed.filter(F.col("origin").isNull()).select(*columns).unionByName(segments.select(F.inline(join_runs("runs"))))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes`` and ``payload_digest`` of revisits taken from the response they name.

    A revisit whose response is missing or damaged gets the damage "missing response".
    """
    whole = records.filter("type = 'response' AND damage IS NULL").groupBy(
        F.col("key").alias("whole_key"), F.col("payload_digest").alias("whole_digest")).agg(F.max("payload_bytes").alias("whole_bytes"))
    again = records.filter("type = 'revisit'").join(
        whole, (F.col("refers_to") == F.col("whole_key")) & (F.col("stated_digest") == F.col("whole_digest")), "left")
    resolved = again.select(*[
        F.col("whole_bytes").alias(c) if c == "payload_bytes" else F.col("whole_digest").alias(c) if c == "payload_digest"
        else F.coalesce("damage", F.when(F.col("whole_key").isNull(), "missing response")).alias(c) if c == "damage" else F.col(c)
        for c in records.columns])
    return records.filter("type IS NULL OR type <> 'revisit'").unionByName(resolved)
