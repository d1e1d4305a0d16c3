"""Legacy web archives (ARC, versions 1 and 2) converted to WARC.

An ARC file begins with a version block whose second line says which fields a record's header line has; each record is
that line, then as many bytes as it declares. The converter gives every record the WARC identifier, timestamp, type and
digests it would have had. Archives are written and read by Spark in the storage of the path given; record bodies never
pass through the driver. Archives are gzipped, one file for each partition written, and read by one task each, record by record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyveil.llm.common import new_folder, prepare, stored, text_of

#: Pages are dealt anew before they are written if their partitions hold more bytes than this on average.
FILE_BYTES = 128 << 20
#: Least bytes of a payload that later records refer back to.
LEAST_REVISIT = 100
#: The HTTP header that carries a record's key, and the date of pages that have none.
KEY_HEADER, DATE = "X-Archive-Key", "20240101000000"

# The fields of ARC header lines by version, the profile of revisit records.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _stream(data: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _one_by_one(names: list[str], kinds: list[pa.DataType], rows: Iterator[tuple], size: int = -1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of about ``most`` bytes of the column at ``size``."""
    held, amount = [], 0
    for row in rows:
        held.append(row)
        amount += len(row[size] or b"") + 200
        if amount >= most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)
            held, amount = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)


def _lines(rows: DataFrame, path: str, separator: str) -> None:
    # The bytes go out as they are: a cast from binary to string checks and changes nothing.
    rows.select(F.col("record").cast("string").alias("value")).write.options(lineSep=separator, compression="gzip").text(path)


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, status: int = 200) -> bytes:
    """The header line of an ARC record."""
    middle = "" if version == 1 else f"{status} - - 0 - "
    return f"{quote(url or '-', safe=''':/?#[]@!$&'()*+,;=-._~%''')} {ip} {date} {kind} {middle}{length}\n".encode()


def _version_block(version: int) -> bytes:
    body = f"{version} 0 tidyveil\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, "filedesc://pages.arc", "0.0.0.0", DATE, "text/plain", len(body)) + body


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", version: int = 1) -> None:
    """``pages`` as ARC files, each page an HTTP response that carries its key in a header."""
    prepare(pages.sparkSession)
    source = pages.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), text_of(html).cast("binary").alias("body"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        yield (_version_block(version),)
        for batch in batches:
            for name, place, body in zip(*(batch.column(k) for k in range(3))):
                payload = body.as_py()
                own = f"{KEY_HEADER}: {name.as_py()}\r\n" if name.is_valid else ""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                yield (arc_header(version, place.as_py(), "0.0.0.0", DATE, "text/html", len(http) + len(payload)) + http + payload,)

    files = -(-int(source.agg(F.sum(F.octet_length("body") + 300)).first()[0] or 0) // FILE_BYTES)
    if source.rdd.getNumPartitions() < files:
        source = source.repartition(files)
    _lines(source.mapInArrow(lambda b: _one_by_one(["record"], [pa.binary()], rows(b)), "record binary"), path, "\n")


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and body of each record after the version block. Raises ValueError where ``data`` is no ARC."""
    stream, at, fields = _stream(data), 0, None
    while line := stream.readline():
        first, at = at, at + len(line)
        if not line.strip():
            continue
        head = line.rstrip(b"\r\n").decode("utf-8", "replace")
        length = head.rsplit(" ", 1)[-1]
        if not length.isdigit() or not line.endswith(b"\n"):
            raise ValueError(f"bad header line at {first}")
        body = stream.read(int(length))
        at += len(body)
        if len(body) < int(length):
            raise ValueError(f"the record at {first} is cut off")
        if fields is None:
            version = body[:1].decode() if head.startswith("filedesc:") else ""
            if version not in ("1", "2"):
                raise ValueError("no version block of version 1 or 2")
            fields = ARC_FIELDS[int(version)]
            continue
        parts = head.rsplit(" ", len(fields) - 1)  # a URL may hold blanks
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields for {len(fields)} in the header line at {first}")
        yield first, dict(zip(fields, parts)), body


def _http(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its empty line, payload, and the headers of an HTTP response; other bodies are all payload."""
    end = body.find(b"\r\n\r\n") if body.startswith(b"HTTP/") else -1
    if end < 0:
        return b"", body, {}
    pairs = (line.partition(":") for line in body[:end].decode("utf-8", "replace").split("\r\n")[1:])
    return body[: end + 4], body[end + 4 :], {a.strip().lower(): b.strip() for a, _, b in pairs}


_RECORD = [
    ("key", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("kind", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("place", pa.string()), ("head", pa.binary()), ("payload", pa.binary()),
]
_RECORD_SCHEMA = "key string, record_id string, uri string, ip string, date string, kind string, payload_digest string, payload_bytes long, place string, head binary, payload binary"


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """What each ARC record under ``path`` is as a WARC record: key, identifier, URI, date, type, digest, body.

    The identifier is a name-based UUID of the record's file, offset, URL, date and digest, so converting again gives the
    same. Dates of 14 digits become ISO times (shorter ones are filled from the start of the year); pages fetched over
    HTTP become responses, anything else resources.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                file = name.as_py().rsplit("/", 1)[-1]
                for at, f, body in arc_records(content.as_py()):
                    head, payload, http = _http(body)
                    digest = hashlib.sha256(payload).hexdigest()
                    d = f["Archive-date"] + "00000101000000"[len(f["Archive-date"]) :]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    name_of = uuid.uuid5(uuid.NAMESPACE_URL, f"{file} {at} {f['URL']} {d} {digest}")
                    kind = "response" if head else "resource"
                    place = f"{file}:{at:020d}"
                    yield (http.get(KEY_HEADER.lower()), f"<urn:uuid:{name_of}>", f["URL"], f["IP-address"], date, kind, digest, len(payload), place, head, payload)

    names, kinds = [n for n, _ in _RECORD], [k for _, k in _RECORD]
    return files.mapInArrow(lambda b: _one_by_one(names, kinds, rows(b)), _RECORD_SCHEMA)


def with_revisits(records: DataFrame, key_type: str = "long", least: int = LEAST_REVISIT) -> DataFrame:
    """``records`` with the column refers_to: of equal payloads of at least ``least`` bytes all but the one with the least
    key become revisits of it. A record without a key comes after those with one; ties go to the first in the archives."""
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").cast(key_type).alias("key"), "place", "record_id", "uri", "date")
    firsts = stored(
        records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"))
        .select(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("n"), "first"), "firsts",
    )
    joined = records.join(firsts, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("n")), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return joined.select(
        *records.columns[:5], F.when(revisit, F.lit("revisit")).otherwise(F.col("kind")).alias("kind"), *records.columns[6:],
        F.when(revisit, F.col("first.record_id")).alias("refers_to"), F.when(revisit, F.col("first.uri")).alias("refers_uri"),
        F.when(revisit, F.col("first.date")).alias("refers_date"),
    )


def _warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def write_warc(records: DataFrame, path: str) -> None:
    """``records`` as WARC files, one for each partition. A revisit keeps the head of its response, and leaves out the payload."""
    prepare(records.sparkSession)
    names = ["record_id", "uri", "ip", "date", "kind", "payload_digest", "refers_to", "refers_uri", "refers_date", "head", "payload"]
    body = F.when(F.col("kind") == "revisit", F.lit(b"")).otherwise(F.col("payload")).alias("payload")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        info = b"software: tidyveil\r\nformat: WARC File Format 1.1\r\n"
        first = True
        for batch in batches:
            for r in batch.to_pylist():
                if first:
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {r['record_id']}")
                    yield (_warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", r["date"]), ("Content-Type", "application/warc-fields")], info),)
                    first = False
                block = r["head"] + r["payload"]
                fields = [
                    ("WARC-Type", r["kind"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]),
                    ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
                    ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                    ("Content-Type", "application/http; msgtype=response" if r["head"] else "application/octet-stream"),
                    ("WARC-Profile", REVISIT_PROFILE if r["refers_to"] else None), ("WARC-Refers-To", r["refers_to"]),
                    ("WARC-Refers-To-Target-URI", r["refers_uri"]), ("WARC-Refers-To-Date", r["refers_date"]),
                ]
                yield (_warc_record(fields, block),)

    source = records.select(*names[:-1], body)
    _lines(source.mapInArrow(lambda b: _one_by_one(["record"], [pa.binary()], rows(b)), "record binary"), path, "\r\n\r\n")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record. Raises ValueError where ``data`` is no WARC."""
    stream = _stream(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, kind, uri, date, payload_digest, refers_to, key and payload of each record but warcinfo, digests checked."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(1):
                for f, block in warc_records(content.as_py()):
                    if f["warc-type"] == "warcinfo":
                        continue
                    _, payload, http = _http(block)
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    if f["warc-type"] != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {f['warc-record-id']} doesn't have its digest")
                    yield (f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f["warc-date"], digest, f.get("warc-refers-to"), http.get(KEY_HEADER.lower()), payload)

    names = ["record_id", "kind", "uri", "date", "payload_digest", "refers_to", "key", "payload"]
    kinds = [pa.string()] * 7 + [pa.binary()]
    schema = ", ".join(f"{n} string" for n in names[:-1]) + ", payload binary"
    return files.mapInArrow(lambda b: _one_by_one(names, kinds, rows(b)), schema)


def records_by_page(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages to ARC, converted to WARC, written, and read back: the record of each page.

    A missing html is an empty payload; a page without a key keeps none; repeated pages are records of their own, of
    which one can be the response. Other columns are not read. An empty table gives no rows.
    """
    spark, key_type = pages.sparkSession, dict(pages.dtypes)["page_id"]
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc, version=version)
    write_warc(with_revisits(convert_arc(spark, arc), key_type), warc)
    back = stored(
        read_warc(spark, warc).select("record_id", "kind", "payload_digest", "refers_to", F.col("key").cast(key_type).alias("page_id"), F.octet_length("payload").cast("long").alias("n")),
        "read",
    )
    whole = back.filter("kind <> 'revisit'").select(F.col("record_id").alias("of"), F.col("page_id").alias("first"), F.col("n").alias("whole"))
    joined = back.join(whole, back["refers_to"] == whole["of"], "left")
    return joined.select("page_id", F.coalesce("whole", "n").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), F.col("first").alias("refers_to"))


SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))"""
