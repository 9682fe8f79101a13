"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: the response (or a revisit, where an equal payload of at least
``REVISIT_BYTES`` is stored elsewhere), the request and a metadata record, the last two
concurrent to the first. Archives are written as gzip text with the record end as line
separator, so any storage that Spark writes will do; they are read as the same byte stream,
in order, and cut into records by their Content-Length, so a payload may hold anything.

Among equal payloads the response is that of the largest page id. Defined results: NULL
html is an empty payload; a NULL url is the empty address; NULL page ids are kept; rows
equal in page id, url and payload are one capture (their record ids are equal); an empty
table writes an empty archive and reads no record. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm.registry import query, table
from foldsmith.session import materialize, new_path

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
END = CRLF + CRLF
REVISIT_BYTES = 1000
# Keys over which the revisits of one response are dealt.
SALTS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "type string, record_id string, concurrent_to string, target_uri string, date string,"
    " refers_to string, payload_digest string, digest_ok boolean, payload_bytes long,"
    " fields map<string,string>, payload string"
)


def record_id(kind: str, page: str = "page_id", url: str = "url") -> Column:
    """The same id on every run: from what the capture consists of."""
    page_text = F.coalesce(F.col(page).cast("string"), F.lit("null"))
    h = F.md5(F.concat_ws(":", F.lit(kind), page_text, F.sha2(F.col(url), 256), "digest"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with digest, size and, for revisits, the page that holds the payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    # Line ends cannot stand in a header.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    stored = (
        rows.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest", "bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("owner"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    joined = rows.join(stored, ["digest", "bytes"], "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner.page_id"))
    return joined.withColumn("owner", F.when(revisit, F.col("owner")))


def header(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit(VERSION + CRLF)]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        # A NULL value leaves the whole line out.
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(END), block)


def records(pages: DataFrame) -> DataFrame:
    """One row per record, ``value`` holding it without its closing line ends."""
    rows = captures(pages)
    revisit = F.col("owner").isNotNull()
    main, digest = record_id("response"), F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    get = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(END))
    about = F.concat(
        F.lit("page-id: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f"{CRLF}payload-length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF),
    )
    common = [("WARC-Date", DATE), ("WARC-Target-URI", F.col("url"))]
    refers = F.when(revisit, record_id("response", "owner.page_id", "owner.url"))
    built = rows.select(
        F.array(
            header(
                [
                    ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
                    ("WARC-Record-ID", main),
                    *common,
                    ("WARC-Payload-Digest", digest),
                    ("WARC-Refers-To", refers),
                    ("WARC-Profile", F.when(revisit, PROFILE)),
                    ("Content-Type", "application/http;msgtype=response"),
                ],
                http,
            ),
            header(
                [
                    ("WARC-Type", "request"),
                    ("WARC-Record-ID", record_id("request")),
                    *common,
                    ("WARC-Concurrent-To", main),
                    ("Content-Type", "application/http;msgtype=request"),
                ],
                get,
            ),
            header(
                [
                    ("WARC-Type", "metadata"),
                    ("WARC-Record-ID", record_id("metadata")),
                    *common,
                    ("WARC-Concurrent-To", main),
                    ("Content-Type", "application/warc-fields"),
                ],
                about,
            ),
        ).alias("all")
    )
    return built.select(F.explode("all").alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Write the captures of ``pages`` as gzip archives into the folder ``path``."""
    records(pages).write.option("lineSep", END).option("compression", "gzip").text(path)


def _cut(stream: bytes) -> tuple[list[tuple[dict, bytes]], bytes]:
    """Whole records at the front of the stream, and the rest."""
    found, at, end = [], 0, END.encode()
    while True:
        # The separator added to the last line of a file is no part of it.
        while stream.startswith(CRLF.encode(), at):
            at += len(CRLF)
        stop = stream.find(end, at)
        if stop < 0:
            break
        lines = stream[at:stop].decode().split(CRLF)
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin = stop + len(end)
        size = int(fields["content-length"])
        if len(stream) < begin + size + len(end):
            break
        found.append((fields, stream[begin : begin + size]))
        at = begin + size + len(end)
    return found, stream[at:]


def _parse(keep_payload: bool):
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def row(fields: dict, block: bytes) -> tuple:
        kind = fields["warc-type"]
        payload, about, size = None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(END.encode())
            about = {"http": http.decode()}
            size = len(payload)
        elif kind == "metadata":
            about = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        ok = hashlib.sha1(payload).hexdigest() == digest if kind == "response" else None
        return (
            kind,
            fields["warc-record-id"],
            fields.get("warc-concurrent-to"),
            fields.get("warc-target-uri"),
            fields.get("warc-date"),
            fields.get("warc-refers-to"),
            digest,
            ok,
            size,
            about,
            payload.decode() if keep_payload and kind == "response" else None,
        )

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, want = [], 0
        rest = b""
        for frame in frames:
            out, size = [], 0
            for value in frame["value"]:
                pending.append(value.encode())
                want -= len(pending[-1]) + len(END)
                if want > 0:
                    continue
                found, rest = _cut(b"".join([rest, *(p + END.encode() for p in pending)]))
                pending, want = [], _missing(rest)
                for fields, block in found:
                    out.append(row(fields, block))
                    size += len(block)
                if size > 16_000_000:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=columns)
        if rest.strip() or any(p.strip() for p in pending):
            raise ValueError("an archive ends inside a record")

    return parse


def _missing(rest: bytes) -> int:
    """Bytes that the record begun in ``rest`` still lacks, as far as that is known."""
    head, found, body = rest.partition(END.encode())
    if not found:
        return 0
    for line in head.split(CRLF.encode()):
        if line.lower().startswith(b"content-length: "):
            return int(line[16:]) + len(END) - len(body)
    return 0


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of all archives in ``path``; gzip files are read whole, each by one task."""
    lines = spark.read.option("lineSep", END).text(path)
    return lines.mapInPandas(_parse(keep_payload), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: main record, request, metadata and what it refers to.

    Requests and metadata name their main record by the concurrent-to id. Equal records
    (of repeated rows) are one.
    """
    parts = [f.strip().split()[0] for f in RECORD.split(", ")]
    whole = F.struct(*parts)
    main = (
        found.where(F.col("type").isin("response", "revisit"))
        .dropDuplicates(["record_id"])
        .select("record_id", whole.alias("main"))
    )

    def linked(kind: str) -> DataFrame:
        rows = found.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.dropDuplicates(["concurrent_to"]).select(
            F.col("concurrent_to").alias("record_id"), whole.alias(kind)
        )

    # The revisits of one response may be a third of all rows: the few responses that are
    # referred to are repeated per salt, and mains without a reference keep a key of their own.
    referred = main.select(F.col("main.refers_to").alias("record_id")).dropna().distinct()
    original = (
        linked("metadata")
        .join(referred, "record_id", "left_semi")
        .select(
            F.col("record_id").alias("_of"),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
            F.col("metadata.fields").alias("original"),
        )
    )
    own = F.concat(F.lit("-"), F.col("record_id"))
    return (
        main.join(linked("request"), "record_id", "left")
        .join(linked("metadata"), "record_id", "left")
        .withColumn("_of", F.coalesce("main.refers_to", own))
        .withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
        .join(original, ["_of", "_salt"], "left")
        .drop("_of", "_salt")
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest FROM p),
o AS (SELECT digest, n, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY 1, 2)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d LEFT JOIN o USING (digest, n)"""


@query("op8_warc", SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled."""
    path = new_path(spark, "archives")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = materialize(read(spark, path, keep_payload=False), "records")
    wrong = found.where(~F.col("digest_ok")).limit(1).count()
    if wrong:
        raise ValueError("a payload differs from its digest")
    return assemble(found).select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("metadata.fields")["payload-length"].cast("long").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.col("original")["page-id"].cast("long").alias("refers_to"),
    )
