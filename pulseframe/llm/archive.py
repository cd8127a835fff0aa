"""Content-addressed web archive: every payload stored once, record headers beside it, records by joins.

An archive is a folder with two Parquet tables. ``payloads`` has each distinct payload once under its
SHA-256; ``headers`` has, for every record, the exact bytes in front of the payload: the WARC header
and, after it, the HTTP header. A response is its header, the payload of its digest and two line ends;
a revisit has no payload of its own and names the response it repeats, so no join ever multiplies a
payload that many records share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.session import scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hex digits make four letters."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(hex_digest, group * 5 + 1, 5), 16, 10).cast("int")
        for place in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(value, place).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def record_id(page_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit("page|"), F.coalesce(page_id.cast("string"), F.lit(""))))
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)) for name, value in fields])


def write_archive(pages: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z", least: int = 0) -> Archive:
    """Write a record per row of ``pages`` (page_id, url, html); other columns are not read.

    The payload is the html in UTF-8, null as empty. Among records with equal payloads of ``least``
    bytes or more, the one with the largest page_id is the response (repeated rows that tie for it are
    all responses, a null page_id only if there is no other) and the rest are revisits of it; shorter
    payloads are all responses. Line ends in a url are percent-encoded, a null url is empty.
    """
    spark = pages.sparkSession
    archive = Archive(path or scratch_path(spark, "archive"))
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    target = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    bodies = pages.select("page_id", target.alias("url"), payload.alias("payload")).select("*", F.sha2("payload", 256).alias("digest"))
    once = bodies.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(archive.payloads)

    winners = spark.read.parquet(archive.payloads).select("digest", "response_id")
    heads = bodies.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1"))
    known = heads.join(winners, "digest")
    response = (F.col("size") < least) | F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}"), lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("size"))), F.lit(END))
    known = known.withColumn("http", http)
    same = [
        ("WARC-Record-ID", record_id(F.col("page_id"))), ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))), ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    full = lines(("WARC-Type", F.lit("response")), *same, ("Content-Length", F.length("http") + F.col("size")))
    again = lines(("WARC-Type", F.lit("revisit")), *same, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", record_id(F.col("response_id"))), ("Content-Length", F.length("http")))
    header = F.concat(F.lit(f"WARC/1.1{END}"), F.when(response, full).otherwise(again), F.lit(END), F.col("http"))
    records = known.select(
        "page_id", record_id(F.col("page_id")).alias("record_id"), F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("response_id")).alias("refers_to"), "digest", F.encode(header, "UTF-8").alias("header"),
    )
    records.write.option("compression", "zstd").parquet(archive.headers)
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record as it was written: page_id, record_type, refers_to and ``record``, its exact bytes.

    Payloads are checked against their SHA-256 as they are read; a wrong one raises.
    """
    headers = spark.read.parquet(archive.headers)
    stored = spark.read.parquet(archive.payloads).select("digest", "payload")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    responses = headers.filter("record_type = 'response'").join(stored.select("digest", sound.alias("payload")), "digest", "left")
    missing = F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("binary")
    close = F.encode(F.lit(END * 2), "UTF-8")
    kept = ["page_id", "record_id", "record_type", "refers_to"]
    whole = responses.select(*kept, F.concat("header", F.coalesce("payload", missing), close).alias("record"))
    return whole.union(headers.filter("record_type = 'revisit'").select(*kept, F.concat("header", close).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """What the bytes of a record say: type, id, referred id, sizes and digest; a response's digest is computed anew and checked."""
    text = F.decode("record", "UTF-8")
    parsed = records.withColumn("_warc", F.substring_index(text, END * 2, 1))
    parsed = parsed.withColumn("_http", F.substring_index(F.substr(text, F.length("_warc") + 5), END * 2, 1))
    field = lambda part, name: F.regexp_extract(part, rf"\r\n{name}: ([^\r\n]*)", 1)
    size = field("_http", "Content-Length").cast("bigint")
    start = F.octet_length("_warc") + F.octet_length("_http") + 8
    body = F.substr("record", (start + 1).cast("int"), size.cast("int"))
    said = F.regexp_extract("_warc", r"\r\nWARC-Payload-Digest: sha1:([^\r\n]*)", 1)
    kind = field("_warc", "WARC-Type")
    block = F.octet_length("_http") + 4 + F.when(kind == "response", size).otherwise(F.lit(0))
    whole = (F.octet_length("record") == start + F.when(kind == "response", size).otherwise(F.lit(0)) + 4) & (field("_warc", "Content-Length").cast("bigint") == block)
    right = whole & ((kind == "revisit") | (base32(F.sha1(body)) == said))
    return parsed.select(
        "page_id", "refers_to", kind.alias("record_type"), field("_warc", "WARC-Record-ID").alias("record_id"), field("_warc", "WARC-Target-URI").alias("url"),
        field("_warc", "WARC-Refers-To").alias("refers_to_id"), size.alias("payload_bytes"),
        F.when(right, said).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))).alias("payload_digest"),
    )
