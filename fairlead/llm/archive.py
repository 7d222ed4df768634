"""WARC archive of notices, content-addressed: each payload once, exact record headers apart, records by joins.

An archive is a folder with two Parquet tables, so that it lives in any store Spark can
write: ``payloads`` (address, payload, slots) holds the bytes of each different notice once
under its SHA-256, and ``headers`` (key, header, address, slot) holds one row per record
with the exact bytes of its WARC and HTTP headers.  A record is its header joined with the
payload at its address; the bytes are measured again when they are read.

One notice may stand in very many records.  Its records are dealt over ``slots`` and its
payload is repeated per slot, in the join alone, so that no task gets all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairlead.llm.common import column
from fairlead.session import stage

# Equal payloads shorter than this are archived as responses of their own, not as revisits.
LEAST_REVISIT_BYTES = 1000
# Records of one payload are counted in this many chunks before the counts meet.
CHUNKS = 256
# Records that share a slot of their payload.
SLOT_RECORDS = 4096

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def _name(key: Column) -> Column:
    """A key as text; null has a name of its own."""
    return F.coalesce(F.concat(F.lit("="), F.url_encode(key.cast("string"))), F.lit("-"))


def _key(name: Column, kind) -> Column:
    return F.when(name.startswith("="), F.url_decode(F.substring(name, 2, 1 << 30))).cast(kind)


def _record_id(key: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:reading:"), _name(key), F.lit(":"), digest, F.lit(">"))


def _line(field: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{field}: "), value, F.lit("\r\n")), F.lit(""))


def _header(media_type: str) -> Column:
    """Exact header bytes of a record: WARC header, then the HTTP header that begins its block."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {media_type}\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    uri = F.regexp_replace(F.regexp_replace("uri", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("key"), F.col("digest"))),
        _line("WARC-Date", F.date_format(F.coalesce("at", F.lit("1970-01-01").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", uri), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("keep"), F.col("digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length.cast("string")),
        F.lit("\r\n"), http,
    ).cast("binary")


def write_archive(
    readings: DataFrame, path: str, key: str = "metric_id", text: str = "construction_notice", uri: str = "record_ref",
    received_at: str | None = None, media_type: str = "text/plain; charset=utf-8", least_bytes: int = LEAST_REVISIT_BYTES,
) -> None:
    """Archive every reading below ``path``: its notice in UTF-8 is the payload, its reference the target URI.

    Of records with equal payloads of ``least_bytes`` or more, that with the largest key is
    the response and the others revisit it; shorter ones are all responses.  A null notice
    is an empty one.  A null key is the smallest key; rows that repeat the largest key with
    the same notice are all responses.  A null reference gives no target line, a null or
    absent time is 1970.  Other columns are ignored; an empty table gives an empty archive.

    The payload bytes are shuffled once, after map-side removal of repeated rows, by
    (address, key): a notice with very many records is spread by their keys.
    """
    root = path.rstrip("/")
    rows = readings.select(
        column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).cast("binary").alias("payload"),
        column(uri).cast("string").alias("uri"),
        (column(received_at) if received_at else F.lit(None)).cast("timestamp").alias("at"),
    ).withColumn("address", F.unhex(F.sha2("payload", 256)))
    light = stage(rows.select(
        "key", "uri", "at", "address", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.pmod(F.xxhash64("key"), F.lit(CHUNKS)).cast("int").alias("chunk"),
    ), "archive-records")

    # Two different payloads under one address would differ in length or in the second digest.
    other = F.xxhash64("digest", "payload_bytes")
    chunks = light.groupBy("address", "chunk").agg(
        F.max("key").alias("keep"), F.count("*").alias("n"), F.min(other).alias("low"), F.max(other).alias("high")
    )
    groups = stage(chunks.groupBy("address").agg(
        F.max("keep").alias("keep"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    ).select(
        "address", F.when(F.col("low") == F.col("high"), F.col("keep")).otherwise(F.raise_error(F.lit("two payloads at one address"))).alias("keep"),
        F.ceil(F.col("n") / SLOT_RECORDS).cast("int").alias("slots"),
    ), "archive-groups")
    shared = groups.join(chunks.select("address", "chunk"), "address")

    is_kept = F.col("key").eqNullSafe(F.col("keep"))
    typed = light.join(shared, ["address", "chunk"]).withColumn(
        "record_type", F.when(is_kept | (F.col("payload_bytes") < least_bytes), "response").otherwise("revisit")
    )
    typed.select(
        "key", _header(media_type).alias("header"), "address", F.pmod(F.xxhash64("key", "digest"), F.col("slots")).cast("int").alias("slot")
    ).write.parquet(f"{root}/headers")

    kept = groups.select("address", _name(F.col("keep")).alias("name"), "slots")
    once = rows.select("address", _name(F.col("key")).alias("name"), "payload").dropDuplicates(["address", "name"])
    once.join(kept.hint("shuffle_hash"), ["address", "name"]).select("address", "payload", "slots").write.parquet(f"{root}/payloads")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str, key: str = "metric_id") -> DataFrame:
    """The records of an archive, each joined from its header and the payload at its address.

    ``<key>``, record_type, refers_to (key of the response that a revisit refers to), uri,
    payload_bytes and payload_digest (SHA-1, both measured on the stored bytes), intact
    (the bytes have the address they are stored under and the digest the header states),
    header and payload (of the response for a revisit).  Where nobody asks for the
    payload, only what was measured on it travels through the join.
    """
    root = path.rstrip("/")
    headers = spark.read.parquet(f"{root}/headers")
    kind = headers.schema["key"].dataType
    stored = spark.read.parquet(f"{root}/payloads").select(
        "address", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        (F.unhex(F.sha2("payload", 256)) == F.col("address")).alias("addressed"),
    )
    referred = F.regexp_extract(_field("WARC-Refers-To"), "^<urn:reading:(.*):[^:]*>$", 1)
    stated = F.concat(F.lit("sha1:"), "payload_digest") == _field("WARC-Payload-Digest")
    return headers.join(stored, ["address", "slot"], "left").select(
        F.col("key").alias(key), _field("WARC-Type").alias("record_type"), _key(referred, kind).alias("refers_to"),
        _field("WARC-Target-URI").alias("uri"), "payload_bytes", "payload_digest",
        F.coalesce(F.col("addressed") & stated, F.lit(False)).alias("intact"), "header", "payload",
    )


def export_warc(archive: DataFrame, folder: str, **options: str) -> None:
    """Write the records of ``read_archive`` as plain WARC files, one per task: header, block, two line ends.

    Use ``compression="gzip"`` for compressed files, ``maxRecordsPerFile`` for smaller ones.
    """
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    # The bytes pass through as they are: neither the cast nor the writer checks them.
    record = F.concat("header", block).cast("string")
    archive.select(record.alias("value")).write.options(**options).option("lineSep", "\r\n\r\n").text(folder)
