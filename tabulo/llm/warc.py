"""WARC archives (operator 11): records written by Spark, read back, and joined into captures.

Writing.  Each page gives three records that name each other: a request and a metadata record point to the response
(or revisit) by WARC-Concurrent-To.  Of pages with equal payloads (SHA-256) of at least ``min_bytes`` bytes,
the one with the smallest id keeps its payload, the others revisit it.  Payloads are dealt out once, by a digest of the whole
row, so a payload that a third of the pages share does not meet in one task; who revisits whom is found on rows
without payloads.  The text sink ends every record with the blank lines that the format wants; archives are gzip files.

Reading.  The text source streams each gzip file in one task and hands out what lies between two version marks ``WARC/1.``.
A mark inside a payload cuts a record in pieces; pieces are put together until the record has as many bytes as its
header says.  Memory holds a few records, never an archive.

Transactions.  Records that name a capture, or that a capture names, join it by those identifiers; records that
name another such record reach the capture through it (to any depth).  One nested row per capture: response and
arrays of requests, metadata and other records.  A capture with more than PART records around it is dealt over
several rows, numbered by ``part``, so no group is collected whole.

Edge cases: null html is an empty payload; a null url leaves out WARC-Target-URI, a null id the page id (null ids come last
when the smallest is taken); control characters and blanks in a url are percent-encoded; rows that repeat everything give
a capture each; records that are cut off or have no valid header are rows with an ``error``; records around a
capture that is missing form a row with a null response; names of the table's other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import stored

#: records around one capture that a row holds at most
PART = 1000
CRLF = "\r\n"
MARK = "WARC/1."
MAIN = ("response", "revisit", "resource")
#: fixed values: base32 digits of the hexadecimal-like digits that conv() gives
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32: every ten hexadecimal digits are eight of base 32."""
    hexa = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_FROM, BASE32_TO)


def _urn(hexa: Column) -> Column:
    """A record id from 32 hexadecimal digits."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(hexa, at, n) for at, n in cuts)), F.lit(">"))


def _safe(url: Column) -> Column:
    odd = "[\\x00-\\x20\\x7F]"
    code = lambda c: F.when(c.rlike(odd), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(odd), F.array_join(F.transform(F.split(url, ""), code), "")).otherwise(url)


def capture_rows(pages: DataFrame, html: str, url: str, id_: str, min_bytes: int) -> DataFrame:
    """(rid, page_id, url, payload, bytes, refers): one row a record to be written; refers is the rid of the record that a
    revisit repeats; rids are unique."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("rid", F.md5(F.to_json(F.struct("page_id", "url", "same"))))
    kept = [F.first(c).alias(c) for c in ("page_id", "url", "same", "bytes", "digest")]

    light = rows.groupBy("rid").agg(*kept, F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "url", "rid")
    firsts = light.where(F.col("bytes") >= min_bytes).groupBy("same").agg(F.min(order).alias("f"), F.sum("copies").alias("m")).where("m > 1")
    repeats = stored(light.join(firsts.select("same", F.col("f.rid").alias("refers")), "same"))
    copy_id = F.when(F.col("copy") == 0, F.col("rid")).otherwise(F.md5(F.concat_ws(":", "rid", F.col("copy").cast("string"))))
    own = F.col("rid") == F.col("refers")  # its copy 0 is the response
    revisits = repeats.withColumn("copy", F.explode(F.sequence(F.when(own, 1).otherwise(0).cast("long"), F.col("copies") - F.when(own, 0).otherwise(1))))
    revisits = revisits.where(~own | (F.col("copy") < F.col("copies")))
    # payloads: rows that repeat everything meet once a task; those below min_bytes are written as often as they come
    once = rows.groupBy("rid").agg(*kept, F.first("payload").alias("payload"), F.count("*").alias("copies"))
    once = once.join(repeats.where(~own).select("rid"), "rid", "left_anti")
    small = F.sequence(F.lit(0).cast("long"), F.when(F.col("bytes") < min_bytes, F.col("copies") - 1).otherwise(0))
    responses = once.withColumn("copy", F.explode(small))
    columns = ["page_id", "url", "bytes", "digest"]
    return responses.select(copy_id.alias("rid"), *columns, "payload", F.lit(None).cast("string").alias("refers")).union(
        revisits.select(copy_id.alias("rid"), *columns, F.lit(b"").alias("payload"), "refers"))


def _record(kind: Column, id_: Column, date: str, content_type: Column, block: Column, *headers: tuple[str, Column]) -> Column:
    """A record without its closing blank lines; headers that are null are left out."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    head = [F.lit(f"{MARK}1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", id_), line("WARC-Date", F.lit(date)), *(line(n, v) for n, v in headers),
            line("Content-Type", content_type), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF)]
    return F.concat(*head, block)


def write_archives(pages: DataFrame, path: str, html: str = "html", url: str = "url", id_: str = "page_id", min_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8") -> None:
    """Write the pages as gzip archives (WARC/1.1) into the folder `path`; date is that of the crawl."""
    rows = capture_rows(pages, html, url, id_, min_bytes)
    target, main = _safe(F.col("url")), _urn(F.col("rid"))
    other = lambda kind: _urn(F.md5(F.concat_ws(":", "rid", F.lit(kind))))
    host = F.regexp_extract(target, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    place = F.regexp_extract(target, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    place = F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place))
    asked = F.coalesce(F.concat(F.lit("GET "), place, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)), F.lit(f"GET / HTTP/1.1{CRLF * 2}"))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2), F.col("payload").cast("string"))
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    revisit = F.col("refers").isNotNull()
    http = lambda kind: F.lit(f"application/http;msgtype={kind}")
    uri = ("WARC-Target-URI", target)
    records = F.array(
        _record(F.lit("request"), other("request"), date, http("request"), asked, ("WARC-Concurrent-To", main), uri),
        _record(F.when(revisit, "revisit").otherwise("response"), main, date, http("response"), answer, uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Refers-To", _urn(F.col("refers"))), ("WARC-Profile", F.when(revisit, REVISIT_PROFILE))),
        _record(F.lit("metadata"), other("metadata"), date, F.lit("application/warc-fields"), fields, ("WARC-Concurrent-To", main), uri))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*(?:\r\n[ \t]+[^\r\n]*)*)\r\n")
SCHEMA = ("file string, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string, "
          "stated_digest string, payload_bytes bigint, payload_digest string, block binary, payload binary, error string")
ARROW = pa.schema([("file", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()),
                   ("date", pa.string()), ("content_type", pa.string()), ("stated_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary()),
                   ("payload", pa.binary()), ("error", pa.string())])
_TAIL = len(CRLF * 2)
#: bytes of records that leave the reader at once
BATCH_BYTES = 16 << 20


def _fields(head: bytes) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for name, value in _FIELD.findall(head):
        found.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
    return found


def _length(record: bytes) -> int | None:
    """Bytes of the record with its blank lines as its header states; None while the header is not complete or not valid."""
    end = record.find(b"\r\n\r\n")
    stated = _fields(record[record.find(b"\r\n") + 2:end + 2]).get("content-length", [""])[0] if end >= 0 else ""
    return end + 4 + int(stated) + _TAIL if stated.isascii() and stated.isdigit() else None


def parse(record: bytes, file: str, keep_payload: bool) -> dict:
    """A row of SCHEMA from a record that begins behind its mark (`1\\r\\n...`)."""
    end = record.find(b"\r\n\r\n")
    length, row = _length(record), dict.fromkeys(ARROW.names) | {"file": file}
    fields = _fields(record[record.find(b"\r\n") + 2:end + 2]) if end >= 0 else {}
    one = lambda name: fields.get(name, [None])[0]
    row |= {"type": one("warc-type"), "record_id": one("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
            "target_uri": one("warc-target-uri"), "date": one("warc-date"), "content_type": one("content-type"), "stated_digest": one("warc-payload-digest")}
    if length is None or row["type"] is None or row["record_id"] is None:
        return row | {"error": "no valid header"}
    if len(record) < length - _TAIL:
        return row | {"error": "cut off"}
    block = record[end + 4:length - _TAIL]
    if row["type"] not in MAIN:
        return row | {"block": block}
    head, payload = block[:0], block
    if (row["content_type"] or "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        head, payload = (block[:cut + 4], block[cut + 4:]) if cut >= 0 else (block, b"")
    stated = row["stated_digest"] or ""
    if row["type"] == "revisit":  # the payload is elsewhere; its length and digest are stated here
        size = _fields(head[head.find(b"\r\n") + 2:]).get("content-length", [""])[0]
        row |= {"payload_bytes": int(size) if size.isascii() and size.isdigit() else None, "payload_digest": stated.removeprefix("sha1:") or None}
    else:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        row |= {"payload_bytes": len(payload), "payload_digest": digest, "error": "wrong digest" if stated.startswith("sha1:") and stated != f"sha1:{digest}" else None}
    return row | {"block": head, "payload": payload if keep_payload else None}


def _records(pieces):
    """(file, record) from the pieces of each file in order."""
    file, held = None, []
    for name, piece in pieces:
        if name != file:
            if held:
                yield file, MARK.encode().join(held)
            file, held = name, []
            if not piece:
                continue  # what lies before the first mark
        held.append(piece)
        whole = held[0] if len(held) == 1 else MARK.encode().join(held)
        if (length := _length(whole)) is not None and len(whole) >= length:
            yield file, whole
            held = []
        elif len(held) > 1:
            held = [whole]
    if held:
        yield file, MARK.encode().join(held)


def _reading(keep_payload: bool):
    def read(batches):
        def pieces():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        rows, size = [], 0
        for file, record in _records(pieces()):
            rows.append(parse(record, file, keep_payload))
            size += len(record)
            if size > BATCH_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
    return read


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row of SCHEMA for each record of the gzip archives in `path`; block is the HTTP header of captures and the whole block of
    other records.  Payload digests are computed from the payloads and compared with the stated ones."""
    pieces = spark.read.option("lineSep", MARK).option("pathGlobFilter", "*.gz").text(path)
    return pieces.select("_metadata.file_path", F.col("value").cast("binary")).mapInArrow(_reading(keep_payload), SCHEMA)


def _resolved(pairs: DataFrame, mains: DataFrame) -> DataFrame:
    """pairs (a, m: record m names a) where a becomes the capture that a chain of names leads to."""
    mains = mains.select(F.col("record_id").alias("a"))
    direct, rest = stored(pairs.join(mains, "a", "left_semi")), stored(pairs.join(mains, "a", "left_anti"))
    found = [direct]
    while not rest.isEmpty():
        through = found[-1].select(F.col("a").alias("capture"), F.col("m").alias("a"))
        more = stored(rest.join(through, "a").select(F.col("capture").alias("a"), "m"))
        if more.isEmpty():
            break
        rest = stored(rest.join(through, "a", "left_anti"))
        found.append(more)
    for x in found[1:]:
        direct = direct.union(x)
    return direct.union(rest).distinct()


def captures(records: DataFrame) -> DataFrame:
    """(record_id, part, response, requests, metadata, others) from records as read_archives gives them; best stored before."""
    sound = records.where("error IS NULL OR error = 'wrong digest'")
    mains = sound.where(F.col("type").isin(*MAIN))
    around = sound.where(~F.col("type").isin(*MAIN))
    named = around.select(F.explode("concurrent_to").alias("a"), F.col("record_id").alias("m"))
    names = mains.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("m"))
    pairs = _resolved(named.union(names.where("a <> m")), mains)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1")
    pairs = pairs.join(sizes, "a", "left").select("a", "m", F.pmod(F.xxhash64("m"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    content = around.select(F.col("record_id").alias("m"), "type", F.struct("record_id", "content_type", "target_uri", "date", F.col("block").cast("string").alias("block")).alias("r"))
    kinds = {"requests": F.col("type") == "request", "metadata": F.col("type") == "metadata", "others": ~F.col("type").isin("request", "metadata")}
    groups = pairs.join(content, "m").groupBy("a", "part").agg(*(F.sort_array(F.collect_list(F.when(k, F.col("r")))).alias(n) for n, k in kinds.items()))
    response = F.struct("file", "type", "refers_to", "target_uri", "date", "stated_digest", "payload_bytes", "payload_digest", F.col("block").cast("string").alias("http_header"), "payload")
    mains = mains.select("record_id", response.alias("response"))
    both = mains.join(groups, F.col("record_id") == F.col("a"), "full")
    return both.select(F.coalesce("record_id", "a").alias("record_id"), F.coalesce("part", F.lit(0)).alias("part"), "response", "requests", "metadata", "others")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def page_captures(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures that write_archives wrote: page ids come from
    the metadata record, refers_to is the page id of the response that a revisit names."""
    of_page = F.regexp_extract(F.col("metadata")[0]["block"], "(?m)^page-id: (-?[0-9]+)", 1)
    rows = stored(found.where("response IS NOT NULL").select("record_id", F.when(of_page != "", of_page).cast("bigint").alias("page_id"), "response.payload_bytes", "response.payload_digest",
                                                             F.col("response.type").alias("record_type"), "response.refers_to"))
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("named"))
    rows = rows.join(named, "refers_to", "left")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("named").alias("refers_to"))
