"""WARC archives: writing one record per row, and reading archives by parallel byte ranges.

Writing. Records whose payloads of at least ``min_bytes`` bytes are equal are
written once, as the response of the largest id; the others become revisit
records that refer to it. Lines of the text writer, ended by two line breaks,
are the records, so Spark's own commit protocol writes the files.

Reading. Magic bytes may stand inside a payload, so a range of a file cannot
tell by itself which of its magics begin a record. Each task takes every magic
of its range as a candidate, with the offset of the record that would follow
it. Within a range the chains of candidates are followed to the offset where
they leave it; over ranges, pointer jumping from the start of the file finds
where the true chain enters each. Only candidates on that chain are records.

Files compressed as gzip members (``.gz``) are read by one task each, as they
can't be cut into ranges; plain ones are read by ranges.

Null payloads are empty, null ids are written without a number. Empty input
gives no files and no records. Headers are never taken from a payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontospark.runtime import drop_materialized, materialize, scratch_path

MIN_BYTES = 1000
#: Revisits (two numbers each) up to which they go to every task rather than through a shuffle with the payloads.
BROADCAST_ROWS = 1 << 20
MAGIC = "WARC/1."
#: The profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(id, digest, refers_to)`` for the rows of ``(id, payload)`` that repeat the payload of a larger id.

    One id may come with several payloads: each is judged by itself. A row
    without an id repeats any row of its payload that has one. Only digests are
    shuffled, counted in each task first.
    """
    slim = records.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    slim = materialize(slim.where(F.col("bytes") >= min_bytes).groupBy("digest", "id").agg(F.count("*").alias("n")), "digests")
    groups = slim.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("ids")).where("ids > 1 and refers_to is not null")
    return slim.join(groups, "digest").where("id is null or id < refers_to").select("id", "digest", "refers_to")


def write_archives(records: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write ``(id, uri string, payload string or binary)`` as WARC files under ``path``; ids of any type with an order.

    Of rows with the same id and payload the repeats are responses too, and so
    are all rows of a payload none of which has an id.
    """
    body = records.select("id", "uri", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    again = materialize(revisits(body, min_bytes).withColumnsRenamed({"id": "old_id", "digest": "old_digest"}), "revisits")
    few = again.count() <= BROADCAST_ROWS
    body = body.withColumn("digest", F.sha1("payload"))
    body = body.join(F.broadcast(again) if few else again, F.col("id").eqNullSafe(F.col("old_id")) & (F.col("digest") == F.col("old_digest")), "left")
    is_revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.when(c.isNull(), F.lit("<urn:record>")).otherwise(F.concat(F.lit("<urn:record:"), F.url_encode(c.cast("string")), F.lit(">")))
    block = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.coalesce("uri", F.lit("")), "[\\x00-\\x20\\x7f]", "%20")
    head = F.concat(
        F.lit(MAGIC + "1\r\n"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)), line("X-Payload-Length", F.octet_length("payload").cast("string")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), block).cast("string").alias("value")
    body.select(record).write.option("lineSep", "\r\n\r\n").text(path)


def _parse(chunk: bytes) -> tuple[dict[str, str], int, int] | None:
    """Header fields, start and length of the block of a record whose bytes after the magic are ``chunk``."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0 or chunk[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    fields = {}
    for line in chunk[3:end].split(b"\r\n"):
        key, sep, value = line.partition(b":")
        if not sep:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    return (fields, end + 4, int(size)) if size.isdecimal() and len(size) < 19 else None


_CANDIDATE = (
    "file string, split long, seq long, at long, total long, next long, leaves long, ok boolean, whole boolean, "
    "type string, id string, uri string, refers_to string, stated_digest string, stated_bytes long, bytes long, digest string"
)


def _record(fields: dict[str, str], payload: bytes) -> tuple:
    return (fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), int(fields["x-payload-length"]) if fields.get("x-payload-length", "").isdecimal() else None, len(payload), hashlib.sha1(payload).hexdigest())


def _follow(offsets: np.ndarray, nexts: np.ndarray, total: int) -> np.ndarray:
    """Where each candidate's chain leaves a range of ``total`` bytes; -1: it breaks off within it."""
    place = {int(o): k for k, o in enumerate(offsets)}
    out = np.full(len(offsets), -1, np.int64)
    for k in range(len(offsets) - 1, -1, -1):
        n = int(nexts[k])
        if n >= total:
            out[k] = n
        elif n >= 0 and n in place:
            out[k] = out[place[n]]
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    key, rows, at = None, [], 0

    def close() -> pd.DataFrame:
        offsets, nexts = np.array([r[3] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        leaves = _follow(offsets, nexts, at)
        return pd.DataFrame([(*r[:4], at, r[5], int(x), *r[7:]) for r, x in zip(rows, leaves)], columns=names).astype({"stated_bytes": "Int64", "bytes": "Int64"})

    for batch in batches:
        for file, split, chunk in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (file, split) != key:
                if rows:
                    yield close()
                key, rows, at = (file, split), [], 0
                skip = split == 0
            if skip:  # what stands before the first magic of the file
                skip, at = False, len(chunk)
                rows.append((file, split, -1, -1, 0, -1, 0, False, True, *[None] * 8))
                continue
            parsed = _parse(chunk)
            if parsed:
                fields, start, size = parsed
                whole = start + size <= len(chunk)
                nxt = at + len(MAGIC) + start + size + 4
                about = _record(fields, chunk[start : start + size]) if whole else (None,) * 8
            else:
                whole, nxt, about = True, -1, (None,) * 8
            rows.append((file, split, len(rows), at, 0, nxt, 0, parsed is not None, whole, *about))
            at += len(MAGIC) + len(chunk)
    if rows:
        yield close()


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, chunk)``: the bytes after each magic up to the next, in order within each range of a file."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("chunk"))


def _entries(nodes: DataFrame) -> DataFrame:
    """``(file, entry)``: the offsets at which the chain from each file's start enters a range.

    ``nodes`` has ``(file, at, leaves)`` for the offsets that some chain enters
    by: about one per range. Each round doubles the length of the jumps.
    """
    jumps = materialize(nodes.where("leaves >= 0"), "jumps")
    reached = materialize(nodes.where("at = 0").select("file", F.col("at").alias("entry")), "reached")
    count = -1
    while (now := reached.count()) != count:
        count = now
        further = reached.join(jumps, (reached.file == jumps.file) & (reached.entry == jumps["at"])).select(reached.file, F.col("leaves").alias("entry"))
        reached, old = materialize(reached.union(further).distinct(), "reached"), reached
        twice = jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("beyond"))
        jumps, before = materialize(jumps.join(twice, ["file", "leaves"]).select("file", "at", F.col("beyond").alias("leaves")), "jumps"), jumps
        drop_materialized(old)
        drop_materialized(before)
    return reached


def _reachable(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range's candidates those on the chain from ``entry``, and for the others the record before them."""
    pdf = pdf.sort_values("at")
    follow = dict(zip(pdf["at"].tolist(), pdf["next"].tolist()))
    entry = pdf["entry"].iloc[0]
    keep, o = set(), None if pd.isna(entry) else int(entry)
    while o in follow and o not in keep:
        keep.add(o)
        o = follow[o]
    pdf["kept"] = pdf["at"].isin(keep)
    pdf["owner"] = pdf["at"].where(pdf["kept"]).ffill()
    return pdf.drop(columns=["entry"])


def _join_payload(key: tuple, table: pa.Table) -> pa.Table:
    """One record from the chunks that its payload's magics cut it into."""
    rows = sorted(zip(table.column("at").to_pylist(), table.column("chunk").to_pylist()))
    data = MAGIC.encode().join(c for _, c in rows)
    fields, start, size = _parse(data)
    file, owner = key[0].as_py(), key[1].as_py()
    got = _record(fields, data[start : start + size]) if len(data) >= start + size else (None,) * 8
    names = ["type", "id", "uri", "refers_to", "stated_digest", "stated_bytes", "bytes", "digest"]
    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()]
    return pa.table({"file": pa.array([file]), "at": pa.array([owner], pa.int64())} | {n: pa.array([v], k) for n, v, k in zip(names, got, kinds)})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, type, id, uri, refers_to, stated_digest, stated_bytes, bytes, digest)`` per record.

    ``bytes`` and ``digest`` (SHA-1) are of the payload as read; the ``stated``
    values are the header's. A record that a file's end cuts off, and whatever
    follows a break of the chain, is left out.
    """
    scan = _scan(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _CANDIDATE.split(", "))])
        for frame in _candidates(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    found = materialize(scan.mapInArrow(run, _CANDIDATE), "candidates")
    # Each range's place in its file: a running sum over one row per range.
    ranges = found.groupBy("file", "split").agg(F.max("total").alias("total"))
    base = ranges.select("file", "split", (F.sum("total").over(Window.partitionBy("file").orderBy("split")) - F.col("total")).alias("base"))
    moved = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(F.lit(-1)).alias(c)
    rest = ["type", "id", "uri", "refers_to", "stated_digest", "stated_bytes", "bytes", "digest"]
    placed = found.where("seq >= 0").join(base, ["file", "split"]).select("file", "split", "seq", moved("at"), moved("next"), moved("leaves"), "ok", "whole", *rest)
    placed = materialize(placed, "placed")
    targets = placed.select("file", F.col("leaves").alias("at")).where("at >= 0").union(placed.where("at = 0").select("file", "at")).distinct()
    entries = _entries(placed.join(targets, ["file", "at"]).select("file", "at", "leaves"))
    where = placed.select("file", "split", "at").join(entries.select("file", F.col("entry").alias("at")), ["file", "at"]).select("file", "split", F.col("at").alias("entry"))
    slim = placed.select("file", "split", "seq", "at", "next", "whole").join(where, ["file", "split"], "left")
    chained = materialize(slim.groupBy("file", "split").applyInPandas(_reachable, "file string, split long, seq long, at long, next long, whole boolean, kept boolean, owner double"), "chained")
    true = chained.where("kept").select("file", "at")
    done = placed.where("ok and whole").join(true, ["file", "at"]).select("file", "at", *rest)
    cut = chained.where("kept and not whole").select("file", F.col("at").alias("owner"), F.col("next").alias("until"))
    cut = materialize(cut, "cut")
    if cut.isEmpty():
        return done
    # Payloads that hold a magic: the false candidates within them bring the rest of the bytes.
    owners = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    suspects = chained.where("not kept or not whole").select("file", "split", "seq", "at", F.when(F.col("kept"), F.col("at")).alias("own"))
    owned = suspects.withColumn("owner", F.last("own", ignorenulls=True).over(owners)).join(cut, ["file", "owner"]).where("at < until")
    wanted = materialize(owned.select("file", "split", F.col("seq").alias("k"), "at", "owner"), "wanted")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, k = None, 0
        for batch in batches:
            places = []
            for file, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (file, split) != key:
                    key, k = (file, split), 0
                places.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "split", "chunk", "k"])

    chunks = scan.mapInArrow(numbered, "file string, split long, chunk binary, k long")
    few = wanted.count() <= BROADCAST_ROWS
    pieces = chunks.join(F.broadcast(wanted) if few else wanted, ["file", "split", "k"]).select("file", "owner", "at", "chunk")
    schema = "file string, at long, type string, id string, uri string, refers_to string, stated_digest string, stated_bytes long, bytes long, digest string"
    joined = pieces.groupBy("file", "owner").applyInArrow(_join_payload, schema).where("bytes is not null")
    return done.unionByName(joined)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` as WARC files and read them back: ``(id, payload_bytes, payload_digest, record_type, refers_to)`` per row.

    Repeated ids with different payloads are records of their own.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    kind = pages.schema[id_col].dataType
    write_archives(pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(payload_col).alias("payload")), f"{path}/archive", min_bytes)
    name = lambda c: F.url_decode(F.when(c.startswith("<urn:record:"), F.substr(c, F.lit(13), F.length(c) - 13))).try_cast(kind)
    return read_archives(spark, f"{path}/archive").select(
        name(F.col("id")).alias("id"),
        F.when(F.col("type") == "revisit", F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        name(F.col("refers_to")).alias("refers_to"),
    )
