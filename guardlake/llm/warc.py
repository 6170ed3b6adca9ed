"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A page is a ``response`` record with an HTTP block, or a ``revisit`` of the page
with the smallest page_id that has the same payload. Only payloads that may occur twice
(by the Bloom filter of this package) shuffle to find that page. Files are plain WARC, so
tasks can read them in splits of any size.

Reading. The archives are read as text that is cut at the magic ``WARC/1.0 CR LF``, so a
split starts at the first magic in it, be that a record or a mention inside a payload.
Each piece is a candidate: its offset comes from sums of piece lengths, first per split,
then in order; its header gives the offset where the next record must start. A candidate
is a record only if a chain of such steps leads to it from offset 0 of its file. The
chains are followed by pointer jumping: each round doubles the length of every jump, so
a file of n records takes about log2(n) rounds of joins on (file, offset), and no file is
ever in one task.

A payload that mentions the magic arrives in several pieces. Its record spans beyond its
piece; only for files with such records the pieces are read again, and those up to the
next record are put together.

Defined results: a null html is an empty payload; a null url has no target field; line
ends in a url are percent-encoded, and so is the last digit of a url that ends in the
magic; rows that repeat the smallest page_id of their payload are all responses; a null
page_id comes after all others; an empty table gives an archive without records. In
reading, a file that does not begin with the magic has no records, and a broken length
ends the chain of its file: ``unread`` lists such files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardlake.llm import bloom
from guardlake.llm.shared import drop, stage

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Base-32 digest: five hex digits are four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages (page_id, url, html) with ``payload`` and ``refers_to``, the page that a revisit points at (null: a response)."""
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    key = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))
    keys, _ = stage(rows.select("page_id", key.alias("key")).filter("key IS NOT NULL"), "payloads")
    filter_ = bloom.repeated(keys, "key", keys.count())
    filter_ = stage(filter_[0], "filter")[0], filter_[1]
    first = bloom.tested(keys, "key", filter_).filter("maybe").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first, _ = stage(first.filter("n > 1").select("key", "first"), "first")
    rows = bloom.tested(rows.withColumn("key", key), "key", filter_)
    straight = rows.filter(~F.col("maybe")).select("page_id", "url", "payload", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"))
    shared = rows.filter("maybe").join(first, "key", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return straight.unionByName(shared)


def record(row: DataFrame) -> Column:
    """One record without the blank lines that end it. Bytes are carried in a string column as they are."""
    uri = F.replace(F.replace(F.regexp_replace("url", r"WARC/1\.0$", "WARC/1.%30"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit(END))
    response = F.col("refers_to").isNull()
    block = F.when(response, F.octet_length(http) + F.octet_length("payload")).otherwise(0)
    lines = [
        F.lit(MAGIC[:-2]),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.when(response, F.lit("Content-Type: application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), block),
    ]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit(END))
    # Binary throughout: the text writer stores a string's bytes unchanged.
    return F.concat(F.encode(head, "UTF-8"), F.when(response, F.concat(F.encode(http, "UTF-8"), F.col("payload"))).otherwise(F.lit(b"")))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive every page under a folder, one file per task of the plan."""
    roles(pages, least).select(record(pages).cast("string").alias("value")).write.option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between magics: file, split (its start), order in the split, bytes."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("order"), F.col("value").cast("binary").alias("piece"))


def _with_offsets(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Offset in its file of the magic before each piece. A piece and its magic take ``size`` bytes."""
    inside = Window.partitionBy("file", "split").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("run", run).join(totals, ["file", "split"]).withColumn(
        "offset", F.col("base") + F.col("run") - len(MAGIC)).drop("run", "base")


def _bases(rows: DataFrame) -> DataFrame:
    """Bytes of each file before each split: one row per split."""
    per_split = rows.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))


def _parsed(rows: DataFrame) -> DataFrame:
    """Header facts of each piece: where the header ends, the length of the block, the fields."""
    head_end = F.instr(F.col("piece").cast("string"), END)
    rows = rows.withColumn("size", (F.octet_length("piece") + len(MAGIC)).cast("long"))
    # A header is ASCII up to its target field; splitting at the blank line gives its bytes.
    rows = rows.withColumn("head", F.when(head_end > 0, F.substring_index(F.col("piece").cast("string"), END, 1)))
    length = F.regexp_extract("head", r"(?i)(?:^|\r\n)content-length:[ \t]*(\d{1,15})[ \t]*(?=\r\n|$)", 1)
    rows = rows.withColumn("length", F.when(length != "", length.cast("long")))
    return rows.withColumn("taken", F.octet_length("head") + len(END) + F.col("length"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row per magic: file, offset, next (where its length leads), and the record's facts if it is whole."""
    rows = _parsed(pieces(spark, path))
    block = F.substring(F.col("piece"), F.octet_length("head") + len(END) + 1, F.col("length").cast("int"))
    rows = rows.withColumn("whole", F.coalesce(F.octet_length("piece") >= F.col("taken"), F.lit(False)))
    rows = rows.withColumn("payload", F.when(F.col("whole"), _payload(F.col("head"), block)))
    return rows.select("file", "split", "order", "size", "taken", "whole", F.when(F.col("taken").isNotNull(), F.col("head")).alias("head"),
                       F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))


def _payload(head: Column, block: Column) -> Column:
    """The payload of a block: what follows the HTTP header, where there is one."""
    http = head.rlike(r"(?i)content-type:[ \t]*application/http")
    start = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END) + 1
    return F.when(http, F.substring(block, start, F.octet_length(block))).otherwise(block)


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, offset) of the records: pointer jumping over (file, offset, next) from offset 0.

    A round adds what one jump from the known records reaches, then joins the jumps with
    themselves. Rounds end when nothing is added; each is a written table.
    """
    spark = nodes.sparkSession
    known, known_path = stage(nodes.filter("offset = 0").select("file", "offset"), "known")
    jumps, jumps_path = stage(nodes.filter("next IS NOT NULL").select("file", "offset", "next"), "jumps")
    places = nodes.select("file", "offset")
    count = known.count()
    while True:
        landed = known.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        landed = landed.join(places, ["file", "offset"], "left_semi")
        more, path = stage(known.unionByName(landed).distinct(), "known")
        total = more.count()
        drop(spark, known_path)
        known, known_path = more, path
        if total == count:
            drop(spark, jumps_path)
            return known
        count = total
        ahead = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        doubled = jumps.join(ahead, ["file", "next"]).select("file", "offset", F.col("after").alias("next"))
        doubled, path = stage(doubled, "jumps")
        drop(spark, jumps_path)
        jumps, jumps_path = doubled, path


def field(name: str, pattern: str = "[^\r\n]*?") -> Column:
    value = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*({pattern})[ \t]*(?=\r\n|$)", 1)
    return F.when(value != "", value)


def records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives: file, offset, head, bytes and digest of its payload; with ``payloads`` also the payload."""
    located, _ = stage(_located(spark, path), "located")
    known = reachable(located.select("file", "offset", "next"))
    kept = located.join(known, ["file", "offset"], "left_semi").filter("taken IS NOT NULL")
    rows, _ = stage(kept.select("file", "offset", "next", "whole", "head", "bytes", "digest"), "records")
    spanning = rows if payloads else rows.filter("NOT whole")
    files = [r["file"] for r in spanning.select("file").distinct().take(1)]
    if not files:
        return rows.select("file", "offset", "head", "bytes", "digest", *[F.lit(b"").alias("payload")] * payloads)
    joined = _reassembled(spark, path, rows, spanning)
    whole = rows.filter("whole").select("file", "offset", "head", "bytes", "digest")
    return joined if payloads else whole.unionByName(joined.drop("payload"))


def _reassembled(spark: SparkSession, path: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records put together from all pieces up to the next record. Pieces are read again, in the files of ``wanted`` only."""
    again = _parsed(pieces(spark, path)).select("file", "split", "order", "size", "piece")
    again = again.join(wanted.select("file").distinct(), "file", "left_semi")
    placed = _with_offsets(again, _bases(again))
    # The record that a piece belongs to is the last one at or before it: kept per split first, then over splits.
    starts = placed.select("file", "split", "order", "offset", "piece").join(
        rows.select("file", "offset", F.col("offset").alias("start"), "next"), ["file", "offset"], "left")
    inside = Window.partitionBy("file", "split").orderBy("order")
    by_split = starts.groupBy("file", "split").agg(F.max("start").alias("last"))
    before = by_split.select("file", "split", F.max("last").over(
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    owned = starts.withColumn("own", F.last("start", True).over(inside)).join(before, ["file", "split"])
    owned = owned.select("file", F.coalesce("own", "carried").alias("record"), "offset", "piece")
    parts = wanted.select("file", F.col("offset").alias("record"), "next", "head").join(owned, ["file", "record"]).filter("offset < next")
    whole = parts.groupBy("file", "record", "head").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
    glued = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0))["piece"],
                        lambda s, p: F.concat(s, F.encode(F.lit(MAGIC), "UTF-8"), p["piece"]))
    block = F.substring(glued, F.octet_length("head") + len(END) + 1,
                        F.regexp_extract("head", r"(?i)(?:^|\r\n)content-length:[ \t]*(\d+)", 1).cast("int"))
    out = whole.select("file", F.col("record").alias("offset"), "head", _payload(F.col("head"), block).alias("payload"))
    return out.select("file", "offset", "head", F.octet_length("payload").cast("long").alias("bytes"),
                      base32_sha1(F.col("payload")).alias("digest"), "payload")


def pages_of(rows: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes its payload's facts from the response."""
    known = rows.select("bytes", "digest", field("WARC-Type").alias("record_type"),
                        field("WARC-Record-ID", "<urn:page:-?[0-9]*>").alias("id"), field("WARC-Refers-To").alias("to"),
                        field("WARC-Payload-Digest").alias("stated"))
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1)
    known = known.withColumn("page_id", F.when(number("id") != "", number("id").cast("long")))
    known = known.withColumn("refers_to", F.when(F.col("to").isNotNull(), number("to").cast("long")))
    response = known.filter("record_type = 'response'").select(
        "page_id", F.lit("response").alias("record_type"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit(None).cast("long").alias("refers_to"))
    targets = known.filter("record_type = 'response'").groupBy(F.col("page_id").alias("target"), F.concat(F.lit("sha1:"), F.col("digest")).alias("held")).agg(
        F.max("bytes").alias("payload_bytes"), F.max("digest").alias("payload_digest"))
    revisits = known.filter("record_type = 'revisit'")
    revisits = revisits.join(targets, (revisits["refers_to"] == targets["target"]) & (revisits["stated"] == targets["held"]), "left")
    return response.unionByName(revisits.select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"))


def unread(spark: SparkSession, path: str) -> DataFrame:
    """Files whose chain ends before the file does: file, bytes up to which it was read, bytes it has."""
    located, _ = stage(_located(spark, path), "located")
    known = reachable(located.select("file", "offset", "next"))
    upto = located.join(known, ["file", "offset"], "left_semi").groupBy("file").agg(F.max("next").alias("read"))
    sizes = located.groupBy("file").agg((F.sum("size") - len(MAGIC)).alias("bytes"))
    return sizes.join(upto, "file", "left").filter("read IS NULL OR read <> bytes")


def _located(spark: SparkSession, path: str) -> DataFrame:
    found, _ = stage(candidates(spark, path), "candidates")
    return _with_offsets(found, _bases(found)).withColumn("next", F.col("offset") + len(MAGIC) + F.col("taken") + len(END))
