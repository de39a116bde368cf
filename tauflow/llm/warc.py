"""WARC archives: write captures, read records back, assemble transactions.

Writing: each page becomes three records that are concurrent to each other: the response (or, for a payload that another
page already has, a revisit without it), the request, and a metadata record. Records are texts built by column
functions, and Spark's text writer puts them into gzip files of a bounded number of records, with the end mark of a
record as line end. Of pages with equal payloads of ``LEAST`` bytes or more, those with the smallest page_id are responses.

Reading: Spark's text reader inflates a file as a stream and cuts it at ``MARK``, the beginning of a record. A cut inside a
payload is undone by the length that the record states, so a payload may hold anything. A task holds one Arrow batch
(bounded by bytes) and one record, however large the archive. Payloads are hashed as they are read. ``assemble`` brings the
records of one capture together by their concurrent-to identifiers in one shuffle and emits one nested row per capture;
``resolve_revisits`` finds what a revisit repeats by the payload's digest. Digests that many pages share are spread
over ``PARTS`` tasks in both joins.

Null html is an empty payload; a null page_id is not written and reads back as null, and is never the smallest;
rows that repeat a page_id and payload are all responses or all revisits; null urls read back as null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauflow.llm.common import record, shared_folder

LEAST, RECORDS_PER_FILE, PARTS, BATCH_BYTES = 100, 30_000, 64, 16 << 20
MARK = b"WARC/1."
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORDS = record(
    record_id="string", type="string", concurrent_to="string", refers_to_uri="string", uri="string", date="string",
    digest="string", payload_bytes="long", fields="string", payload="binary",
)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, **headers: Column | str | None) -> Column:
    """Text of one record; headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    for name, value in headers.items():
        text = F.lit(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(name.replace("_", "-") + ": "), text))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), F.lit(END), block)


def _part(*columns: str) -> Column:
    """Splits rows of one digest among tasks."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int")


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared work folder of the cluster."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def write_captures(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write one capture per row of ``pages`` (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("bigint").alias("n"),
    )
    # Payloads below the limit are no one's copy and stay out of the join.
    rows = rows.withColumn("_part", _part("page_id", "url"))
    small, large = rows.where(F.col("n") < least), rows.where(F.col("n") >= least)
    parts = large.groupBy("digest", "_part").agg(
        F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("_same"))
    groups = (
        parts.groupBy("digest").agg(F.min("first").alias("_first"), F.min_by("first_url", "first").alias("_first_url"), F.sum("_same").alias("_same"))
        .where("_same > 1").drop("_same")
    )
    repeated = parts.select("digest", "_part").join(groups, "digest")
    rows = large.join(repeated, ["digest", "_part"], "left").unionByName(small, allowMissingColumns=True)
    rows = rows.withColumnsRenamed({"_first": "first", "_first_url": "first_url"})
    rows = rows.withColumn("_new", F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ids = {kind: _urn(F.lit(kind), F.col("_row"), F.col("page_id"), F.col("digest")) for kind in ("response", "request", "metadata")}
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    target, digest = F.col("url"), F.concat(F.lit("sha256:"), F.col("digest"))
    answer = F.when(
        F.col("_new"),
        _record("response", ids["response"], F.concat(status, F.col("html")), WARC_Target_URI=target, WARC_Payload_Digest=digest,
                Content_Type="application/http; msgtype=response"),
    ).otherwise(
        _record("revisit", ids["response"], status, WARC_Target_URI=target, WARC_Payload_Digest=digest,
                WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                WARC_Refers_To_Target_URI=F.col("first_url"), WARC_Refers_To_Date=DATE,
                Content_Type="application/http; msgtype=response")
    )
    request = _record(
        "request", ids["request"], F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{END}")),
        WARC_Target_URI=target, WARC_Concurrent_To=ids["response"], Content_Type="application/http; msgtype=request",
    )
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: spark\r\n"))
    metadata = _record(
        "metadata", ids["metadata"], fields, WARC_Target_URI=target, WARC_Concurrent_To=ids["response"], Content_Type="application/warc-fields",
    )
    out = rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one archive in memory, see ``records_of``."""
    return records_of(data.split(MARK))


def records_of(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Records of one archive that comes in pieces, cut at every ``MARK``; the lengths that records state tell which cuts
    are theirs. Anything else between records, or a broken end, raises an error rather than losing records."""
    pieces = iter(pieces)
    if next(pieces, b"").strip(b"\r\n"):
        raise ValueError("the archive does not begin with a record")
    for piece in pieces:
        parts, size = [piece], len(piece)
        while (end := piece.find(END.encode())) < 0:  # a mark inside the head
            piece = piece + MARK + _next(pieces)
            parts, size = [piece], len(piece)
        heads: dict[str, str] = {}
        for line in piece[:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            heads.setdefault(name.strip().lower(), value.strip())
        start = end + len(END)
        stop = start + int(heads["content-length"])
        while size < stop:
            parts += [MARK, _next(pieces)]
            size += len(MARK) + len(parts[-1])
        whole = b"".join(parts)
        if whole[stop:].strip(b"\r\n"):
            raise ValueError(f"a record is longer than it states: {heads.get('warc-record-id')}")
        yield {"heads": heads, "block": whole[start:stop]}


def _next(pieces: Iterator[bytes]) -> bytes:
    piece = next(pieces, None)
    if piece is None:
        raise ValueError("archive ends inside a record")
    return piece


def _row(r: dict, with_payload: bool) -> tuple:
    heads, block = r["heads"], r["block"]
    kind, payload, digest = heads.get("warc-type"), None, heads.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest = hashlib.sha256(payload).hexdigest()
    return (
        heads.get("warc-record-id"), kind, heads.get("warc-concurrent-to"), heads.get("warc-refers-to-target-uri"),
        heads.get("warc-target-uri"), heads.get("warc-date"), digest, None if payload is None else len(payload),
        block.decode() if kind == "metadata" else None, payload if with_payload else None,
    )


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives (``*.gz``) in a folder. A gzip file is read by one task, from its beginning to its end."""

    def pieces_by_file(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from zip(batch["file"], batch["piece"])

    def parse(batches: Iterator[pd.DataFrame]):
        rows, held = [], 0
        for _, pieces in groupby(pieces_by_file(batches), key=lambda p: p[0]):
            for r in records_of(piece for _, piece in pieces):
                rows.append(_row(r, with_payload))
                held += len(r["block"]) if with_payload else 0
                if len(rows) == 2000 or held > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=RECORDS.names).astype({"payload_bytes": "Int64"})
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=RECORDS.names).astype({"payload_bytes": "Int64"})

    files = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", MARK.decode()).text(path)
    pieces = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInPandas(parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, answer (response or revisit), request, metadata.

    Requests and metadata name the answer they are concurrent to; an answer is its own capture. A record whose
    answer is missing still gives a row (answer null).
    """
    is_answer = F.col("type").isin("response", "revisit", "resource")
    capture = F.when(is_answer, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    columns = [c for c in records.columns if c != "concurrent_to"]
    whole = F.struct(*columns)

    def one(kind: Column) -> Column:
        return F.min_by(F.when(kind, whole), F.when(kind, F.col("record_id")))

    return records.groupBy(capture.alias("capture_id")).agg(
        one(is_answer).alias("answer"), one(F.col("type") == "request").alias("request"), one(F.col("type") == "metadata").alias("metadata")
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures."""
    page_id = F.regexp_extract("metadata.fields", r"(?m)^page-id: (-?\d+)\r?$", 1)
    flat = captures.where(F.col("answer").isNotNull()).select(
        F.when(page_id != "", page_id.cast("bigint")).alias("page_id"), F.col("answer.uri").alias("url"),
        F.col("answer.payload_bytes").alias("payload_bytes"), F.col("answer.digest").alias("payload_digest"),
        F.col("answer.type").alias("record_type"),
    )
    whole = flat.where(F.col("record_type") == "response")
    firsts = whole.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("payload_bytes").alias("full"))
    revisits = flat.where(F.col("record_type") == "revisit").withColumn("_part", _part("page_id", "url"))
    told = revisits.select("payload_digest", "_part").distinct().join(firsts, "payload_digest")
    revisits = revisits.join(told, ["payload_digest", "_part"], "left").select(
        "page_id", "url", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", F.col("first").alias("refers_to")
    )
    return whole.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, and return one row per capture."""
    spark = pages.sparkSession
    path = path or archive_folder(spark)
    write_captures(pages, path)
    found = resolve_revisits(assemble(read_records(spark, path, with_payload=False)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
