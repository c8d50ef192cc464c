"""WARC archives: write records, and read them back by verified record boundaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rundiff.session import cut_lineage, shared_folder

LEAST_REVISIT = 100
_MAGIC = b"WARC/1."
_BETWEEN = b"\r\n" + _MAGIC  # what lies between two candidate records
_ROW = (
    "file string, block long, idx long, rel long, next long, leave long, whole boolean, end long, record_id string, record_type string, "
    "target_uri string, refers_to string, payload_bytes long, payload_digest string"
)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> None:
    """Writes one record per row to uncompressed WARC 1.0 files in ``folder``.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest key become response records
    and all others revisit records that refer to it. Payloads are found equal by their SHA-256; only the digests
    that occur more than once are joined, one row each, so payloads move only if those digests are many.
    Null payloads are empty, null keys count as larger than all others, null addresses are left out.
    Rows that repeat the smallest key are all responses.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload"))
    copies = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k"))
    copies = cut_lineage(copies.where("k > 1 AND first IS NOT NULL").select("digest", "first"))
    rows = rows.join(copies, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(head, F.when(again, F.lit("")).otherwise(F.col("payload")))
    no_breaks = F.translate(F.col("url"), "\r\n", "")
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("id")),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), no_breaks)),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            again,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                record_id(F.col("first")),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    rows.select(F.concat(header, block, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(folder)


def _parse(piece):
    """Header fields, start of the block and its length of a candidate that follows the magic; None if it is no record."""
    if piece[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None
    return fields, end + 4, int(length)


def _describe(fields, block):
    """(payload bytes, digest) of a whole block; a revisit has the digest of its header and no payload."""
    import hashlib

    if fields.get(b"warc-type") == b"revisit":
        return None, fields.get(b"warc-payload-digest", b"").partition(b":")[2].decode("utf-8", "replace")
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        end = block.find(b"\r\n\r\n")
        block = block[end + 4 :] if end >= 0 else b""
    return len(block), hashlib.sha256(block).hexdigest()


def _candidates(batches):
    """Each piece between two magics as a candidate record, with the place where its successor must start.

    Positions count from the start of the first piece of the split. ``leave`` is the first position beyond
    the split that a chain from the candidate reaches, or where it ends.
    """
    import pyarrow as pa

    def answer(file, block, rows):
        at = {row[1]: i for i, row in enumerate(rows)}
        leave = [row[2] for row in rows]
        for i in range(len(rows) - 1, -1, -1):
            if rows[i][2] in at and at[rows[i][2]] > i:
                leave[i] = leave[at[rows[i][2]]]
        out = [(file, block, row[0], row[1], row[2], leave[i], *row[3:]) for i, row in enumerate(rows)]
        for a in range(0, len(out), 4096):
            columns = zip(*out[a : a + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [f.split()[0] for f in _ROW.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in _ROW.split(", ")]
    now, rows, at = None, [], 0
    for batch in batches:
        for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value")):
            value = value.as_buffer().to_pybytes()
            if (file, block) != now:
                if rows:
                    yield from answer(*now, rows)
                now, rows, at = (file, block), [], 0
            begin = at - len(_MAGIC)
            end = at + len(value) + len(_BETWEEN)
            if block == 0 and not rows:
                known = value.startswith(_MAGIC)
                value, begin, at = value[len(_MAGIC) :], 0, len(_MAGIC)
            else:
                known = True
            parsed = _parse(value) if known else None
            if parsed is None:
                rows.append((len(rows), begin, None, False, end, None, None, None, None, None, None))
            else:
                fields, start, length = parsed
                whole = start + length <= len(value)
                size, digest = _describe(fields, value[start : start + length]) if whole else (None, None)
                texts = [fields.get(k, b"").decode("utf-8", "replace") or None for k in (b"warc-record-id", b"warc-type", b"warc-target-uri", b"warc-refers-to")]
                rows.append((len(rows), begin, at + start + length + 4, whole, end, *texts, size, digest))
            at = end
    if rows:
        yield from answer(*now, rows)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("lineSep", _BETWEEN.decode()).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _reached(candidates: DataFrame) -> DataFrame:
    """(file, entry): the first record of each split that a chain from the start of its file enters.

    Pointer jumping: each round, what is reached also reaches its pointers, and pointers double.
    """
    now = cut_lineage(candidates.select("file", "pos", F.col("leave").alias("jump"), (F.col("pos") == 0).alias("hit")))
    count = -1
    while True:
        hits = now.where("hit AND jump IS NOT NULL").select("file", F.col("jump").alias("pos")).distinct().withColumn("new", F.lit(True))
        jumps = now.select("file", F.col("pos").alias("jump"), F.col("jump").alias("far"))
        stepped = now.join(hits, ["file", "pos"], "left").join(jumps, ["file", "jump"], "left")
        now = cut_lineage(stepped.select("file", "pos", F.col("far").alias("jump"), (F.col("hit") | F.coalesce("new", F.lit(False))).alias("hit")))
        reached = now.where("hit").count()
        if reached == count:
            return now.where("hit").select("file", F.col("pos").alias("entry"))
        count = reached


def _follow(table):
    """The records of one split on the chain from its entry, and for every other piece the record it belongs to."""
    import pyarrow as pa

    table = table.sort_by("idx")
    starts, follows, entries = (table.column(c).to_pylist() for c in ("pos", "next", "entered"))
    at = {p: i for i, p in enumerate(starts)}
    on = [False] * len(starts)
    for i in (i for i, e in enumerate(entries) if e):
        while i is not None and not on[i]:
            on[i] = True
            i = at.get(follows[i])
    return table.append_column("real", pa.array(on))


def _joined(batches):
    """Digests of the records whose payload holds magics, from their pieces in order."""
    import pyarrow as pa

    def answer(key, pieces):
        parsed = _parse(b"".join(pieces)[len(_MAGIC) :])
        fields, start, length = parsed
        block = b"".join(pieces)[len(_MAGIC) + start :][:length]
        return (*key, *_describe(fields, block))

    key, pieces, out = None, [], []
    for batch in batches:
        for file, owner, pos, value in zip(*(batch.column(c).to_pylist() for c in ("file", "owner", "pos", "value"))):
            if (file, owner) != key:
                if pieces:
                    out.append(answer(key, pieces))
                key, pieces = (file, owner), []
            pieces.append((_MAGIC if pos == 0 else b"\r\n" + _MAGIC if pieces else _MAGIC) + (value[len(_MAGIC) :] if pos == 0 else value))
    if pieces:
        out.append(answer(key, pieces))
    columns = list(zip(*out)) if out else [[]] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "pos", "full_bytes", "full_digest"])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all uncompressed WARC 1.x files of a folder.

    (file, pos, record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest). Files are read
    in splits. Each task emits candidate records, the pieces between two magics, with the place where the
    successor of each must start. Only what a chain from the start of the file reaches is a record, so a magic
    or a whole record inside a payload is not. Records whose payload holds magics are put together from their
    pieces. A chain that breaks, in a damaged file, ends there. Revisit records have no payload_bytes and the
    digest of their header. An empty folder gives no rows.
    """
    found = cut_lineage(_scan(spark, folder).mapInArrow(_candidates, _ROW))
    splits = found.groupBy("file", "block").agg(F.max("end").alias("size"), F.max("idx").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("above"))
    placed = found.join(cut_lineage(splits), ["file", "block"])
    placed = placed.withColumn("pos", F.col("base") + F.col("rel")).withColumn("next", F.col("base") + F.col("next")).withColumn("leave", F.col("base") + F.col("leave"))
    placed = cut_lineage(placed.withColumn("piece", F.col("above") + F.col("idx")).drop("above", "rel", "end"))
    entries = _reached(placed).withColumnRenamed("entry", "pos").withColumn("entered", F.lit(True))
    entered = placed.join(entries, ["file", "pos"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    links = entered.select("file", "block", "idx", "pos", "next", "entered", "piece", "whole")
    marked = cut_lineage(
        links.groupBy("file", "block").applyInArrow(_follow, "file string, block long, idx long, pos long, next long, entered boolean, piece long, whole boolean, real boolean")
    )
    records = placed.join(marked.where("real").select("file", "pos"), ["file", "pos"])
    broken = marked.where("real AND NOT whole").select("file", "pos", "piece", "next")
    if not broken.isEmpty():
        # pieces up to the next record belong to a record with magics inside
        later = marked.where("real").select("file", F.col("pos").alias("next"), F.col("piece").alias("until"))
        last = marked.groupBy("file").agg((F.max("piece") + 1).alias("all"))
        ranges = broken.join(later, ["file", "next"], "left").join(last, "file")
        owners = ranges.select("file", F.col("pos").alias("owner"), F.explode(F.sequence("piece", F.coalesce("until", "all") - 1)).alias("piece"))
        pieces = marked.join(cut_lineage(owners), ["file", "piece"]).select("file", "block", "idx", "pos", "owner")
        contents = _scan(spark, folder).mapInArrow(_numbered, "file string, block long, idx long, value binary")
        content = contents.join(cut_lineage(pieces), ["file", "block", "idx"]).select("file", "owner", "pos", "value")
        full = content.repartition("file", "owner").sortWithinPartitions("file", "owner", "pos").mapInArrow(_joined, "file string, pos long, full_bytes long, full_digest string")
        records = records.join(full, ["file", "pos"], "left")
        records = records.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes"))
        records = records.withColumn("payload_digest", F.coalesce("payload_digest", "full_digest"))
    return records.select("file", "pos", "record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest")


def _numbered(batches):
    """Numbers the pieces of each split as the first scan did."""
    import pyarrow as pa

    now, idx = None, 0
    for batch in batches:
        numbers = []
        for place in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            now, idx = place, idx + 1 if place == now else 0
            numbers.append(idx)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(numbers, pa.int64()), batch.column("value")], names=["file", "block", "idx", "value"])


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes all rows as WARC records to the shared folder, reads the archives back, and returns one row per record:
    (key, payload_bytes, payload_digest, record_type, refers_to). A revisit has the size of the payload it refers to.
    Nulls, ties and repeated rows are as in ``write_warc``; other columns are ignored; an empty table gives no rows."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/rundiff-warc-{uuid.uuid4().hex}"
    write_warc(pages, folder, key, url, html, least)
    records = cut_lineage(read_warc(spark, folder).drop("file", "pos", "target_uri"))
    referred = records.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("origin")).distinct()
    sizes = records.where("record_type = 'response'").join(referred, F.col("record_id") == F.col("origin"))
    sizes = sizes.groupBy("origin", F.col("payload_digest").alias("same")).agg(F.max("payload_bytes").alias("full"))
    rows = records.join(sizes, (F.col("refers_to") == F.col("origin")) & (F.col("payload_digest") == F.col("same")), "left")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    as_key = lambda c: F.when(number(F.col(c)) != "", number(F.col(c)).cast("long"))
    return rows.select(
        as_key("record_id").alias(key),
        F.coalesce("payload_bytes", "full").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        as_key("refers_to").alias("refers_to"),
    )
