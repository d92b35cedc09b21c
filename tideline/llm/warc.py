"""WARC archives without repeated payloads, and reading them back.

Payloads are told apart by their SHA-1. Headers alone are grouped by it: of records with equal payloads of at least
``least`` bytes the one with the smallest id is a response, the others become revisit records that refer to it. Archives
are written by Spark's text writer, one record to a row, so they lie wherever Spark can write; each is a gzip file of
WARC/1.1 records with headers made anew. They are read by Spark's text reader, and the bytes are parsed by
Content-Length, so a payload may hold any text. A response read back must have the digest its header names.

A null payload is empty. A missing id comes after all others, and its records carry none; a missing address is left out. Of
records with equal ids and payloads the first in the table counts as the smallest. Equal payloads may be any share of the
rows: they are pre-aggregated and joined back by a join that broadcasts the few largest groups. Line ends in keys and addresses
are escaped in the headers; keys come back as they were, as text. Very long payloads are whole in one task, one at a time; other columns are not
read, and a table without rows gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import join_counted, scratch, store
from tideline.shipping import ship_package

#: A fixed value of the format: the digits of base 32.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of payload in one archive, about.
ARCHIVE = 64 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexed: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: five hexadecimal digits are four digits."""
    out = []
    for i in range(8):
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(DIGITS), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, none where the value is missing."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))


def one_line(text: Column) -> Column:
    """A text without line ends, which would start a new header."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Resolve revisits and write archives below ``path``."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").alias("key"), one_line(F.col(f"`{url}`")).alias("url"), body.alias("body"),
        F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),  # stays, as it is written
    )
    rows = store(rows.withColumn("id", _record_id(F.col("key"), F.col("row"), F.col("sha"))), "pages")
    heads = rows.where(F.col("size") >= least).select("row", "sha", F.struct(F.col("key").isNull().alias("none"), "key", "row", "id", "url").alias("first"))
    equal = heads.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("origin")).where("n > 1")
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    revisits = join_counted(heads.select("row", "sha"), equal, "sha", "n", total, F.col("row")).where("row <> origin.row")
    records = rows.join(revisits.select(F.col("row").alias("again"), "origin"), F.col("row") == F.col("again"), "left")
    response = F.col("again").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.concat(http, F.when(response, F.col("body")).otherwise(F.lit("")))
    # a text goes into the header as one line, in which a percent sign is escaped too, and comes back whole
    source = one_line(F.replace(F.col("key"), F.lit("%"), F.lit("%25"))) if isinstance(pages.schema[key].dataType, T.StringType) else F.col("key")
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit")),
        _line("WARC-Record-ID", F.col("id")), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("X-Source-ID", source), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        _line("WARC-Profile", F.when(~response, F.lit(PROFILE))), _line("WARC-Refers-To", F.col("origin.id")),
        _line("WARC-Refers-To-Target-URI", F.col("origin.url")), _line("WARC-Refers-To-Date", F.when(~response, F.lit(date))),
        F.lit("\r\nContent-Type: application/http; msgtype=response"), _line("Content-Length", F.octet_length(block)), F.lit(END), block,
    )
    per_file = max(1, ARCHIVE * total // max(1, size))
    records.select(value.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of the records of a stream of bytes."""
    held = b""
    mark = END.encode()
    for data in stream:
        # between records only line ends are left: a payload that ends in one hides where its archive ends
        held = (held + data).lstrip(b"\r\n")
        while (at := held.find(mark)) >= 0:
            lines = held[:at].decode().split("\r\n")
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            stop = at + 4 + int(headers["content-length"])
            if len(held) < stop + 4:
                need = [held]  # gather without copying again and again
                have = len(held)
                for more in stream:
                    need.append(more)
                    have += len(more)
                    if have >= stop + 4:
                        break
                held = b"".join(need)
                if have < stop + 4:
                    raise ValueError("an archive ends within a record")
            yield headers, held[at + 4 : stop]
            held = held[stop + 4 :].lstrip(b"\r\n")


def unescaped(source: str | None) -> str | None:
    return source and source.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def read_archives(spark, path: str) -> DataFrame:
    """A row per record: type, id, address, source id, referred id, and digest, size and bytes of the payload (null in revisits)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = END.encode()
        stream = (x + mark for batch in batches for x in batch.column("value").cast(pa.binary()).to_pylist())
        names = ["type", "id", "url", "source", "refers", "digest", "size", "payload"]
        out, filled = [], 0
        for h, block in parse(stream):
            payload, size = None, None
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if h["warc-type"] == "response":
                payload = block[block.index(mark) + 4 :]
                size = len(payload)
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {h['warc-record-id']} has another digest")
            out.append((h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), unescaped(h.get("x-source-id")), h.get("warc-refers-to"), digest, size, payload))
            filled += len(block) + 400
            if filled > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, filled = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    lines = spark.read.option("lineSep", END).text(path)
    return lines.mapInArrow(run, "type string, id string, url string, source string, refers string, digest string, size long, payload binary")


def resolve(records: DataFrame) -> DataFrame:
    """Records without payloads, revisits with ``origin`` (source id) and size of the response they refer to."""
    records = store(records.drop("payload"), "records")
    again = records.where("type = 'revisit'").drop("size")
    counted = again.groupBy(F.col("refers").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    origin = records.where("type = 'response'").join(counted, F.col("id") == F.col("of")).select(F.col("of").alias("refers"), "n", F.col("source").alias("origin"), "size")
    known = join_counted(again, origin, "refers", "n", again.count(), F.col("id"))
    first = records.where("type = 'response'").withColumn("origin", F.lit(None).cast("string"))
    return first.unionByName(known.drop("n"))


def deduplicated(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write archives to a new folder of the shared place and list the records read back."""
    path = scratch(pages.sparkSession, "archives")
    write_archives(pages, path, key, url, payload, least)
    return resolve(read_archives(pages.sparkSession, path))
