"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, the headers of each record in full beside it, and
records are put together again by a join. A digest is only trusted after the payloads it stands for
agree in length and SHA-1, and each stored payload is digested again when it is read.

Of records with equal payloads that with the smallest page id is the response, the others are
revisits that refer to it (repeated rows of that page are responses too; null ids come last). Null
html counts as empty, null URLs give no WARC-Target-URI. Only `page_id`, `url` and `html` are read.
An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.session import pin, shared_path

#: Fixed value: the base-32 letters of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE = "\r\n"
LATEST = (1 << 63) - 1


def base32(hex_digest: Column) -> Column:
    """A hex digest whose bits divide by 20 (as SHA-1's do) in base 32."""
    # Five hex digits are 20 bits and so four letters.
    def letters(i: Column) -> Column:
        bits = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        one = lambda shift: F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1))
        return F.concat(*[one(s) for s in (15, 10, 5, 0)])

    return F.concat(*[letters(F.lit(i)) for i in range(8)])


def describe(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and its digests."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "*",
        F.sha2("payload", 256).alias("digest"),
        F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )


def _headers(row: dict[str, Column], date: str) -> Column:
    """The header block of a record, blank line included."""
    is_response = row["record_type"] == "response"
    clean = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), row["record_type"]),
        F.concat(F.lit("WARC-Record-ID: "), urn(row["page_id"])),
        F.concat(F.lit("WARC-Target-URI: "), clean(row["url"])),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(row["sha1"])),
        F.when(~is_response, F.concat(F.lit("WARC-Refers-To: "), urn(row["refers_to"]))),
        F.when(~is_response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(is_response, F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(is_response, row["payload_bytes"]).otherwise(0).cast("string")),
    ]
    # concat_ws leaves out null lines.
    return F.concat(F.concat_ws(LINE, *lines), F.lit(LINE * 2))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes `folder`/headers and `folder`/payloads.

    Payloads under `least_bytes` are never replaced by a reference, though still stored once.
    """
    facts = pin(describe(pages).drop("payload"), "warc-facts")
    order = F.coalesce("page_id", F.lit(LATEST))
    firsts = facts.groupBy("digest").agg(
        F.min(order).alias("_first"),
        (F.min("sha1").eqNullSafe(F.max("sha1")) & (F.min("payload_bytes") == F.max("payload_bytes"))).alias("_same"),
    )
    checked = firsts.withColumn("_first", F.when(F.col("_same"), F.col("_first")).otherwise(F.raise_error(F.lit("digest collision"))))
    firsts = pin(checked.drop("_same"), "warc-firsts")
    own = (order == F.col("_first")) | (F.col("payload_bytes") < least_bytes)
    records = facts.join(firsts, "digest").withColumns(
        {
            "record_type": F.when(own, "response").otherwise("revisit"),
            "refers_to": F.when(~own & (F.col("_first") != LATEST), F.col("_first")),
        }
    )
    row = {c: F.col(c) for c in ("page_id", "url", "sha1", "payload_bytes", "record_type", "refers_to")}
    records.select("digest", _headers(row, date).alias("headers")).write.parquet(f"{folder}/headers")
    # The rows that carry a digest's first page id: one each, unless a page repeats.
    first_rows = firsts.select("digest", F.col("_first").alias("_order"))
    stored = describe(pages).withColumn("_order", order).join(first_rows, ["digest", "_order"], "left_semi")
    repeats = facts.groupBy("digest", order.alias("_order")).count().filter("count > 1").join(first_rows, ["digest", "_order"], "left_semi")
    stored = stored.select("digest", "payload", "_order")
    once = stored.join(repeats, ["digest", "_order"], "left_anti")
    # Repeated first pages, rare: their payloads are equal, any one will do.
    again = stored.join(repeats.select("digest", "_order"), ["digest", "_order"], "left_semi").groupBy("digest").agg(F.min("payload").alias("payload"))
    once.select("digest", "payload").unionByName(again).write.parquet(f"{folder}/payloads")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads; one whose bytes do not have the digest it is kept under stops the read."""
    stored = spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.lit("damaged payload")))
    return stored.select(
        sound.alias("digest"),
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records put together again: what their headers say, the full payload and its facts, and `record`,
    the bytes of the WARC record."""
    headers = spark.read.parquet(f"{folder}/headers")
    # Java's ^ also stands behind U+0085, U+2028 and U+2029, which a url may hold.
    field = lambda name: F.regexp_extract("headers", rf"\r\n{name}: ([^\r\n]*)", 1)
    number = lambda name: F.nullif(F.regexp_extract("headers", rf"\r\n{name}: <urn:page:([^>]*)>", 1), F.lit(""))
    joined = headers.join(payloads(spark, folder), "digest", "left")
    block = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(
        number("WARC-Record-ID").cast("bigint").alias("page_id"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").cast("bigint").alias("refers_to"),
        F.regexp_extract("headers", r"\r\nWARC-Payload-Digest: sha1:(\w*)", 1).alias("stated_digest"),
        "payload_bytes",
        "payload_digest",
        "payload",
        F.concat(F.encode("headers", "UTF-8"), block, F.lit(f"{LINE * 2}".encode())).alias("record"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    write(pages, folder)
    return read(spark, folder)
