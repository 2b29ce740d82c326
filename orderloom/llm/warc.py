"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: each record is one text row, closed by the blank line that WARC asks for (the writer's line separator), so
every task writes its own archive to any store that Spark can write to.

Reading: Spark's text reader cuts the archives, by byte ranges, at the magic `WARC/1.0`; a magic may also stand inside a
payload, so each cut is only a candidate. A task emits for each candidate the offset of its successor, which the
candidate's own Content-Length gives. Pointer jumping from the start of each file (inside a byte range in the task, then
over ranges by joins that double the reach) keeps the candidates that a chain from offset 0 reaches; the others lie in
payloads. Records cut by a false magic are put together again from their pieces.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.llm.common import shared_folder, staged, tidy

MAGIC = "WARC/1.0\r\n"
CLOSE = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 1000


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null: empty), payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least 1000 bytes the largest page_id is the response, the others revisit it. Rows that share
    that page_id as well are all responses; a null page_id is smaller than any other.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    first = large.groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first_id")
    # written first, so that the planner knows its size: a small one is broadcast, a large one is joined by a shuffle
    first = staged(first, "warc-first")
    rows = rows.join(first, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_warc(typed: DataFrame, path: str) -> None:
    """One archive for each task. Revisits carry no payload, only its digest and length and the record they refer to."""
    again = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    length = F.when(again, F.lit(len(HTTP))).otherwise(F.col("payload_bytes") + len(HTTP))
    head = [
        (F.lit("WARC-Type"), F.col("record_type")),
        (F.lit("WARC-Record-ID"), urn(F.col("page_id"))),
        (F.lit("WARC-Date"), F.lit("1970-01-01T00:00:00Z")),
        (F.lit("WARC-Target-URI"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        (F.lit("WARC-Refers-To"), F.when(again, urn(F.col("refers_to")))),
        (F.lit("WARC-Profile"), F.when(again, F.lit(PROFILE))),
        (F.lit("X-Payload-Length"), F.when(again, F.col("payload_bytes").cast("string"))),
        (F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
        (F.lit("Content-Length"), length.cast("string")),
    ]
    lines = F.concat_ws("\r\n", *[F.when(v.isNotNull(), F.concat(k, F.lit(": "), v)) for k, v in head])
    block = F.concat(F.lit(HTTP), F.when(again, F.lit("")).otherwise(F.col("payload")))
    typed.select(F.concat(F.lit(MAGIC), lines, F.lit(CLOSE), block).alias("value")).write.option("lineSep", CLOSE).text(path)


FIELD = re.compile(rb"(?:^|\r\n)([A-Za-z-]+):[ \t]*([^\r\n]*)")
PARSED = "type string, record_id string, uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def parse_record(text: bytes, keep: bool) -> dict:
    """Fields of a whole record, given what follows its magic. The digest is worked out from the payload; a revisit, which has none, gives the noted one."""
    head, _, rest = text.partition(b"\r\n\r\n")
    f = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(head)}
    block = rest[: int(f["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
    again = f.get("warc-type") == "revisit"
    noted = int(n) if (n := f.get("x-payload-length", "")).isdigit() else None
    return {
        "type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to"),
        "payload_bytes": noted if again else len(payload),
        "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") if again else hashlib.sha1(payload).hexdigest(),
        "payload": payload if keep and not again else None,
    }


def successor(text: bytes) -> int:
    """Bytes from after the magic to the next record's start, by the header alone; -1 without a valid header."""
    head, sep, _ = text.partition(b"\r\n\r\n")
    n = [v for k, v in FIELD.findall(head) if k.lower() == b"content-length"]
    return len(head) + 8 + int(n[0]) if sep and len(n) == 1 and n[0].isdigit() else -1


INDEX = f"file string, block bigint, idx int, rel bigint, nbytes bigint, jump bigint, out bigint, total bigint, self boolean, rec struct<{PARSED}>"


def candidates(raw: DataFrame, keep: bool) -> DataFrame:
    """A row for each piece between two magics. All offsets are relative to the first piece of the byte range.

    rel: the candidate's magic; jump: its successor; out: where the chain of candidates leaves this range (null: it
    breaks); self: the piece is a whole record, whose fields are in rec.
    """
    s, schema = len(MAGIC), None
    rec = pa.struct([("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("idx", pa.int32()), ("rel", pa.int64()), ("nbytes", pa.int64()), ("jump", pa.int64()), ("out", pa.int64()), ("total", pa.int64()), ("self", pa.bool_()), ("rec", rec)])

    def close(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        rel, nbytes, step = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        total = int(nbytes.sum()) + s * len(rows)
        jump = np.where(step >= 0, rel + s + step, -1)
        at = np.minimum(np.searchsorted(rel, jump), len(rel) - 1)
        inside = (step >= 0) & (jump < total - s)
        hop = np.where(inside & (rel[at] == jump), at, -1)
        out = np.where(inside | (step < 0), np.int64(-1), jump)
        for _ in range(max(1, len(rel)).bit_length() + 1):  # pointer jumping inside the range
            out = np.where(hop >= 0, out[hop], out)
            hop = np.where(hop >= 0, hop[hop], -1)
        null = lambda x: pa.array(x, pa.int64(), mask=x < 0)
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(rel), pa.array(nbytes), null(jump), null(out), pa.array([total] * n, pa.int64()), pa.array([r[3] is not None for r in rows]), pa.array([r[3] for r in rows], rec)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, at = None, [], 0
        for batch in batches:
            for file, block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (file, block) != key:
                    if rows:
                        yield close(key, rows)
                    key, rows, at = (file, block), [], 0
                step = successor(text)
                rows.append((at - s, len(text), step, parse_record(text, keep) if step == len(text) else None))
                at += len(text) + s
        if rows:
            yield close(key, rows)

    return raw.mapInArrow(tidy(run), INDEX)


def reached(index: DataFrame) -> DataFrame:
    """file, block, entry: for each byte range the candidate by which the chain from the file's start comes into it."""
    ends = index.groupBy("file", "block").agg(F.first("total").alias("total"))
    base = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ends.select("file", "block", base.alias("base"))
    placed = index.join(bases, ["file", "block"]).select("file", "block", "idx", "nbytes", "self", (F.col("rel") + F.col("base")).alias("off"), (F.col("jump") + F.col("base")).alias("succ"), (F.col("out") + F.col("base")).alias("out"))
    placed = staged(placed, "warc-placed")
    known = placed.where("off = 0").select("file", "off")
    hops = placed.where("out is not null").select("file", "off", "out")
    n = known.count()
    while True:
        step = known.join(hops, ["file", "off"]).select("file", F.col("out").alias("off"))
        real = step.join(placed.select("file", "off"), ["file", "off"], "left_semi")
        known = staged(known.union(real).distinct(), "warc-reached")
        if (now := known.count()) == n:
            return placed, known
        n = now
        far = hops.select("file", F.col("off").alias("out"), F.col("out").alias("to"))
        hops = staged(hops.join(far, ["file", "out"]).select("file", "off", F.col("to").alias("out")), "warc-hops")


def true_records(placed: DataFrame, entries: DataFrame) -> DataFrame:
    """Marks the candidates on the chain: in each byte range from its entry on. Adds `real`."""
    marked = placed.join(entries.withColumn("entry", F.lit(True)), ["file", "off"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off", ignore_index=True)
        place = {o: i for i, o in enumerate(pdf["off"])}
        real = np.zeros(len(pdf), bool)
        succ = pdf["succ"].fillna(-1).astype("int64").to_numpy()
        for i in np.flatnonzero(pdf["entry"].fillna(False).astype(bool).to_numpy()):
            while i is not None and not real[i]:
                real[i] = True
                i = place.get(succ[i])
        return pdf.assign(real=real)[["file", "block", "idx", "self", "off", "succ", "real"]]

    return marked.select("file", "block", "idx", "self", "off", "succ", "entry").groupBy("file", "block").applyInPandas(run, "file string, block bigint, idx int, self boolean, off bigint, succ bigint, real boolean")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """file, off and the fields of each record of the archives below path (uncompressed); payloads only when asked for.

    Magic strings inside payloads give no record; bytes before a file's first magic leave the file without records, as a
    chain must start at offset 0.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("bigint").alias("block"), F.col("value").cast("binary").alias("value"))
    index = staged(candidates(raw, payloads), "warc-index")
    placed, entries = reached(index)
    real = staged(true_records(placed, entries), "warc-real")
    whole = index.where("self").join(real.where("real and self").select("file", "block", "idx", "off"), ["file", "block", "idx"]).select("file", "off", "rec.*")
    if real.where("real and not self").isEmpty():
        return whole
    owner = F.last(F.when(F.col("real"), F.struct("off", "self")), ignorenulls=True).over(Window.partitionBy("file").orderBy("off"))
    parts = real.withColumn("owner", owner).where("not owner.self").select("file", "block", "idx", F.col("off").alias("at"), F.col("owner.off").alias("off"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for batch in batches:
            idx = []
            for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = n + 1 if k == key else 0
                key = k
                idx.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(idx, pa.int32()), batch.column(2)], ["file", "block", "idx", "value"])

    pieces = raw.mapInArrow(tidy(numbered), "file string, block bigint, idx int, value binary").join(parts, ["file", "block", "idx"])
    sewn = pieces.groupBy("file", "off").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    glue = F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1)["value"], lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["value"]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_record(t, payloads) for t in batch.column(2).to_pylist()]
            cols = {f: [r[f] for r in rows] for f in ("type", "record_id", "uri", "refers_to", "payload_bytes", "payload_digest", "payload")}
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)]], ["file", "off", *cols])

    return whole.unionByName(sewn.select("file", "off", glue.alias("value")).mapInArrow(tidy(parse), f"file string, off bigint, {PARSED}"))


def op8_warc(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives (to a new folder in the shared one, if no path is given), reads them back, one row a page."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(with_types(pages), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    return read_warc(spark, path).select(whole(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), whole(F.col("refers_to")).alias("refers_to"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
