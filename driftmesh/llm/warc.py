"""WARC archives: writing pages as records, and reassembling segmented, chunked records on reading.

Writing. Each page becomes a record. Of pages with equal payloads of at least `least_bytes`, the one with the largest
page_id is a response and the others revisit it. Payloads travel in chunked transfer framing; blocks beyond
`segment_bytes` are cut into a first record and continuations, which may land in any file. Archives are files of raw
records in the shared folder, written by Spark's own text sink, so any store that Spark writes will do. A row of the sink
holds a warcinfo record and about ROW_BYTES of records, a file ROWS_PER_FILE rows, so files are bounded by bytes.

Reading. Files are parsed by Content-Length; segments are grouped by the identifier of their origin, ordered by
number, checked for gaps and against the total length, joined, and the chunked framing of the HTTP body is undone.

Revisits name the record that they refer to (its identifier comes from page and payload) and, in an extension field, its
page. Null html counts as empty. Null page_ids are written without the field and come back null; a null never is the
largest. Pages that repeat the largest page_id are all responses; with equal payloads they are one record written twice.
Very long pages become many segments. An empty table gives no records. Other columns of the input, whatever their names,
are not looked at. A record that misses a segment or whose digest or length disagrees raises an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm.common import look_up, materialize, shared_dir, slices

LEAST_BYTES = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
ROW_BYTES, ROWS_PER_FILE = 1 << 20, 64

#: Fixed values of the format.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
RECORD_END = "\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Undoes chunked transfer framing; sizes may have extensions, trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + CRLF + head + CRLF + block


def _uri(url: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "%" + c.encode().hex("%") for c in url or "about:blank")


DATE = ("WARC-Date", "2026-01-01T00:00:00Z")


def _target(page_id: int | None, digest: str) -> str:
    """The identifier of a record that others revisit."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _encode(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # identifiers are unique by task and place; a task that runs again replaces its files whole
        space, count, out, held = uuid.uuid5(uuid.NAMESPACE_OID, f"{uuid.uuid4()}-{TaskContext.get().partitionId()}"), 0, [], 0

        def row():
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(space, f'info/{count}')}>"), DATE, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join([info, *out])], pa.binary())], names=["record"])

        for batch in slices(batches):
            for page in batch.to_pylist():
                payload = page["html"]
                digest = hashlib.sha1(payload).hexdigest()
                name = _target(page["page_id"], digest) if page["target"] else f"<urn:uuid:{uuid.uuid5(space, str(count))}>"
                count += 1
                uri = ("WARC-Target-URI", _uri(page["url"]))
                fields = [
                    ("WARC-Type", "revisit" if page["revisits"] else "response"), ("WARC-Record-ID", name), DATE, uri, ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page["page_id"]),
                ]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if page["revisits"]:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _target(page["refers_to"], digest)), ("X-Refers-To-Page-ID", page["refers_to"])]
                    records = [_record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))]
                else:
                    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                    records = [_record(fields + [("WARC-Segment-Number", 1)] * (len(parts) > 1), parts[0])]
                    for k, part in enumerate(parts[1:], 2):
                        total = len(block) if k == len(parts) else None
                        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(space, f'{count}/{k}')}>"), DATE, uri]
                        records.append(_record([*more, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
                for record in records:
                    out.append(record)
                    held += len(record)
                    if held >= ROW_BYTES:
                        yield row()
                        count, out, held = count + 1, [], 0
        if out:
            yield row()

    return run


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html as bytes, revisits, refers_to, target). Payloads stay where they are: hashes that several pages
    share, with the largest page_id, are looked up."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html")
    )
    of_payload = F.unhex(F.sha2("html", 256))
    long_ones = rows.filter(F.length("html") >= least_bytes).select("page_id", of_payload.alias("hash"))
    groups = materialize(long_ones.groupBy("hash").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "payloads")
    # short pages look up a key of their own that no group has
    own = F.unhex(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")))
    joined = look_up(rows.withColumn("hash", F.when(F.length("html") >= least_bytes, of_payload).otherwise(own)), groups, "hash", "left")
    same = F.col("page_id").eqNullSafe(F.col("largest"))
    revisits = F.col("largest").isNotNull() & ~same
    return joined.select("page_id", "url", "html", revisits.alias("revisits"), F.when(revisits, F.col("largest")).alias("refers_to"), (F.col("largest").isNotNull() & same).alias("target"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, rows_per_file: int = ROWS_PER_FILE, compression: str = "gzip") -> None:
    """Writes pages (page_id, url, html) as archives under path; compression: gzip (of whole files) or none."""
    records = with_revisits(pages, least_bytes).mapInArrow(_encode(segment_bytes, chunk_bytes), "record binary")
    # the text sink writes the bytes of a string as they are
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", rows_per_file).option("compression", compression).text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of an archive's bytes."""
    at = 0
    while at < len(content):
        if content[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = content.index(CRLF + CRLF, at)
        fields = {}
        for line in content[at:end].split(CRLF)[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode()] = value.strip().decode()
        start = end + 4
        stop = start + int(fields["content-length"])
        if content[stop : stop + 4] != CRLF + CRLF:
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield fields, content[start:stop]
        at = stop + 4


_SEGMENTS = "origin string, number int, total long, type string, page_id long, refers_to long, uri string, digest string, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]
    as_int = lambda x: None if x is None else int(x)
    for batch in slices(batches, 1):
        content = batch.column(0)[0].as_py()
        if content[:2] == b"\x1f\x8b":
            content = gzip.decompress(content)
        rows = []
        for f, block in parse_records(content):
            if f["warc-type"] == "warcinfo":
                continue
            rows.append((
                f.get("warc-segment-origin-id", f["warc-record-id"]), as_int(f.get("warc-segment-number")), as_int(f.get("warc-segment-total-length")), f["warc-type"],
                as_int(f.get("x-page-id")), as_int(f.get("x-refers-to-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest"), block,
            ))
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parse, _SEGMENTS)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per record: whole ones pass as they are, segments meet by their origin. A group is one record's parts."""
    whole = segments.filter("number is null").select("origin", "type", "page_id", "refers_to", "uri", "digest", "block")
    part = F.struct("number", "block")
    grouped = segments.filter("number is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.max("total").alias("total"),
        *[F.max(c).alias(c) for c in ("page_id", "refers_to", "uri", "digest")], F.max(F.when(F.col("number") == 1, F.col("type"))).alias("type"),
    )
    joined = grouped.withColumn("block", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["block"])), "")))
    gapless = F.forall(F.transform("parts", lambda x, i: x["number"] == i + 1), lambda ok: ok)
    checked = joined.withColumn(
        "block", F.when(gapless & (F.length("block") == F.col("total")), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("broken record "), F.col("origin"))).cast("binary"))
    )
    return whole.unionByName(checked.select(whole.columns))


_RECORDS = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in slices(batches):
        rows = []
        for r in batch.to_pylist():
            head, _, body = r["block"].partition(CRLF + CRLF)
            fields = dict(line.lower().split(b": ", 1) for line in head.split(CRLF)[1:])
            said = (r["digest"] or "").removeprefix("sha1:")
            if r["type"] == "revisit":
                rows.append((r["page_id"], r["uri"], "revisit", r["refers_to"], int(fields[b"content-length"]), said, None))
                continue
            payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
            digest = hashlib.sha1(payload).hexdigest()
            if said and digest != said:
                raise ValueError(f"payload digest of {r['origin']} disagrees")
            rows.append((r["page_id"], r["uri"], r["type"], None, len(payload), digest, payload))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _RECORDS.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload); payload is null for revisits."""
    return reassemble(read_segments(spark, path)).mapInArrow(_payloads, _RECORDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(spark, path)
