"""WARC archives: revisit resolution by payload digest, distributed writing, streaming reading."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import scratch, shielded, written

CRLF = "\r\n"
MIN_BYTES = 100


@shielded(("payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_uri"), "page_id", "url", "html")
def resolve_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` with ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``refers_to_uri``.

    Only headers (id, url, digest) are grouped, with counts combined before the shuffle. Digests of two pages or more are written first, so
    that Spark knows their size: a small table is sent to the pages, and only a large one makes the pages themselves shuffle. Digests found
    once never meet their page again. A null page_id is never the original while another holds the payload; a group of nulls alone is all response.
    Of repeated rows with one page_id, all are the original.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    df = pages.withColumns({"payload_bytes": F.length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    heads = df.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_digest")).agg(F.count(F.lit(1)).alias("_n"), F.min(page_id).alias("_first"), F.min_by(F.coalesce(F.col(url), F.lit("urn:none")), page_id).alias("_uri"))
    shared = written(heads.filter("_n > 1").drop("_n"), "digests")
    df = df.join(shared, F.col("payload_digest") == F.col("_digest"), "left").drop("_digest")
    revisit = F.col("_first").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("_first"))
    return df.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_first")), "refers_to_uri": F.when(revisit, F.col("_uri"))})


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One gzip archive a task under ``path``; each record has fresh headers, a revisit has no payload.

    Spark's text writer puts the bytes down, so any file system Spark reaches will do and failed tasks leave nothing.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("urn:none")), r"[\r\n]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length(payload))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col(page_id)),
        F.lit(f"{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(F.col("refers_to")), F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), F.regexp_replace("refers_to_uri", r"[\r\n]", ""), F.lit(f"{CRLF}WARC-Refers-To-Date: {date}"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF),
    )
    record = F.concat(head, http, F.when(revisit, F.lit("")).otherwise(payload), F.lit(CRLF))  # the writer adds the last CRLF
    resolved.select(record.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def _page(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def _records(lines):
    """(headers, block) of each record from the CRLF-separated lines of whole archives; holds one record at a time."""
    state, head, size, parts, got = "start", {}, 0, [], 0
    for line in lines:
        if state == "start":
            if line.startswith(b"WARC/"):
                state, head = "head", {}
        elif state == "head":
            if line:
                key, _, value = line.partition(b":")
                head[key.decode().lower()] = value.strip().decode()
            else:
                size, parts, got, state = int(head["content-length"]), [], 0, "block"
        else:
            parts.append(line)
            got += len(line) + 2
            if got >= size + 2:
                yield head, b"\r\n".join(parts)[:size]
                state = "start"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: page_id, url, record_type, payload_digest (of the header), refers_to, payload (null for revisits), payload_sha256."""
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary, payload_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def parse(batches):
        lines = (x.as_buffer().to_pybytes() for b in batches for x in b.column(0).cast(pa.binary()))
        rows, held = [], 0
        for head, block in _records(lines):
            revisit = head["warc-type"] == "revisit"
            payload = None if revisit else block.partition(b"\r\n\r\n")[2]
            rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:"), _page(head["warc-refers-to"]) if revisit else None, payload, None if revisit else hashlib.sha256(payload).hexdigest()))
            held += len(block)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.option("lineSep", CRLF).text(path).mapInArrow(parse, schema)


def deduplicate(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as deduplicated archives and returns the records read back.

    Null and repeated rows are judged as resolve_revisits says. Revisits are joined to the responses they refer to, from which they get ``payload_bytes``. Null html is an empty payload;
    an empty table makes empty archives; other columns are not archived.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(resolve_revisits(pages.select("page_id", "url", "html"), min_bytes=min_bytes), path)
    back = written(read_archives(spark, path).withColumn("n", F.length("payload").cast("long")).drop("payload"), "records")  # read and parsed once
    heads = back.filter("record_type = 'revisit'").select("page_id", "url", "record_type", "payload_digest", "refers_to")
    originals = back.filter("record_type = 'response'").groupBy(F.col("payload_sha256").alias("_d"), F.col("page_id").alias("_page")).agg(F.max("n").alias("payload_bytes"))
    originals = written(originals, "originals")  # so that a digest of many revisits is split in the join
    responses = back.filter("record_type = 'response'").select("page_id", "url", F.col("n").alias("payload_bytes"), F.col("payload_sha256").alias("payload_digest"), "record_type", "refers_to")
    revisits = heads.join(originals, (F.col("payload_digest") == F.col("_d")) & (F.col("refers_to") == F.col("_page"))).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)
