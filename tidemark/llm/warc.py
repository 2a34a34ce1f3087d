"""Content-addressed WARC archive: payload bytes once by verified digest, exact headers apart, records by join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import base32_of_hex, scratch

CRLF = "\r\n"
#: What stands for characters that would end a header line, and for the mark of these.
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
#: Records of one payload beyond which they are rebuilt in several tasks.
CROWD = 10_000


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")


def _record_id(id_: Column) -> Column:
    """A URN made from the record's own id, so that reruns write the same bytes."""
    h = F.md5(F.concat(F.lit("tidemark-record-"), id_.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] * (i > 1) + [F.substring(h, i, n)])], F.lit(">"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``path/payloads`` (digest, payload), one row for each distinct payload, ``path/headers``
    (record_id, digest, header), one for each record, with the exact bytes of its WARC header block, and
    ``path/layout``, the number of buckets of the payloads.

    Of records with equal payloads of ``at_least`` bytes or more, the one with the smallest id is the
    response and the others revisit it; smaller payloads are all responses. Payloads are strings, stored
    as UTF-8, or binary; null counts as empty. They are addressed by SHA-256 and length; headers also
    carry SHA-1 in base 32, as archives usually do. Equal payloads fold in each task before they are
    shuffled, so one that a third of all pages share moves once for each task; they are stored in
    buckets by digest, so that records are rebuilt without moving them again.

    A url may hold any characters: one with a line break is written with %, CR and LF escaped and a line that says so.
    Null urls give a record without a target line, empty ones an empty one. A null id makes a record without a record id, which is
    always a response and never revisited. Rows that repeat an id and payload are each a response. An empty table gives two empty
    tables; other columns are not read.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("target"), body.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload")).alias("digest"))
    # payloads stay behind: only ids, urls and digests meet to find who is first
    thin = rows.select("id", "target", "digest", "size", base32_of_hex(F.sha1("payload")).alias("sha1"))
    first = thin.groupBy("digest").agg(F.min("id").alias("origin"))
    headed = thin.join(first, "digest", "left")
    revisit = (F.col("size") >= at_least) & F.col("id").isNotNull() & (F.col("id") != F.col("origin"))
    kind = F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response")
    broken, escaped = F.col("target").rlike("[\\r\\n]"), F.col("target")
    for c, code in ESCAPES:
        escaped = F.replace(escaped, F.lit(c), F.lit(code))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(F.col("id").isNotNull(), _record_id(F.col("id")))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", F.when(broken, escaped).otherwise(F.col("target"))),
        _line("X-Target-URI-Escaped", F.when(broken, F.lit("yes"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Refers-To", F.when(kind == "revisit", _record_id(F.col("origin")))),
        _line("WARC-Profile", F.when(kind == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("X-Source-ID", F.col("id").cast("string")),
        _line("X-Refers-To-Source-ID", F.when(kind == "revisit", F.col("origin").cast("string"))),
        _line("Content-Length", F.when(kind == "revisit", "0").otherwise(F.col("size").cast("string"))),
    )
    headed.select(F.col("id").alias("record_id"), "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    name = f"payloads_{uuid.uuid4().hex}"
    stored.write.bucketBy(buckets, "digest").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of an archive, in its buckets; a payload whose bytes don't give its digest raises an error."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    name = f"payloads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (digest STRING, payload BINARY) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/payloads'")
    stored = spark.table(name)
    stored.schema  # resolved: the name may go, the files stay  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    again = F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload"))
    wrong = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
    return stored.select("digest", F.when(again == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def _field(name: str, whole: bool = False) -> Column:
    """The value of a header line, null if there is none or, unless asked for the ``whole``, it is empty.

    Lines end at line feeds alone: values may hold the other characters that Unicode counts as line ends.
    """
    found = F.regexp_extract("head", f"(?md)^{name}: ([^\\r\\n]*)", 1)
    return F.when(F.col("head").rlike(f"(?md)^{name}: ") if whole else found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header blocks of an archive and their parsed fields, with the digest of the payload that each names."""
    head = spark.read.parquet(f"{path}/headers").select("digest", "header", F.decode("header", "UTF-8").alias("head"))
    target = plain = _field("WARC-Target-URI", whole=True)
    for c, code in reversed(ESCAPES):
        plain = F.replace(plain, F.lit(code), F.lit(c))
    return head.select(
        "digest", "header", _field("WARC-Type").alias("record_type"), _field("X-Source-ID").cast("long").alias("record_id"), _field("X-Refers-To-Source-ID").cast("long").alias("refers_to"),
        F.when(_field("X-Target-URI-Escaped") == "yes", plain).otherwise(target).alias("target"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: header, payload (a revisit's is the one that it refers to) and parsed fields.

    record_type, record_id, refers_to (ids of the source rows), target, payload_digest, payload_bytes,
    header, payload. The payload side is verified, and headers are joined to it by digest: they go to
    the payloads' buckets. Payloads with more than CROWD records, of which there are few, are copied for
    every CROWD records, which so are spread over tasks.
    """
    heads, payloads = read_headers(spark, path), read_payloads(spark, path)
    crowded = heads.groupBy(F.col("digest").alias("of")).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")).where("parts > 1")
    heads = heads.join(crowded, F.col("digest") == F.col("of"), "left").drop("of")
    few = heads.where("parts is null").drop("parts").join(payloads, "digest")
    copied = payloads.join(crowded, F.col("digest") == F.col("of")).select("of", "payload", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))
    many = heads.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("record_id", "target"), F.col("parts")).cast("int"))
    many = many.join(copied, (F.col("digest") == F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "of_part", "part", "parts")
    whole = few.unionByName(many)
    return whole.select("record_type", "record_id", "refers_to", "target", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """(record_id, record): each record as it stands in a WARC file, a revisit with its header alone."""
    end = F.lit((CRLF * 2).encode())
    block = F.when(F.col("record_type") == "revisit", F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    return records.select("record_id", F.concat("header", F.lit(CRLF.encode()), block, end).alias("record"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    whole = read_archive(spark, path).withColumn("found", base32_of_hex(F.sha1("payload")))
    verified = F.when(F.col("found") == F.col("payload_digest"), F.col("found")).otherwise(F.raise_error(F.lit("a payload differs from its record's digest")).cast("string"))
    return whole.select(F.col("record_id").alias("page_id"), "payload_bytes", verified.alias("payload_digest"), "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS origin FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(k // 4 AS INT) * 5 + 1, 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM d JOIN f USING (h)
"""
