"""WARC archives: writing with revisit records, and reading by boundary chains.

Records are written by Spark's text writer. Of equal payloads of at least
``revisit_from`` bytes, the record with the smallest page id carries the payload
and the others are revisits that refer to it.

Archives are compressed, as is usual; a compressed file is read by one task, so
files hold at most ``records_a_file`` records. Offsets are those of the text.

Reading splits archives at every occurrence of the version line, in parallel.
Such a place is only a candidate, since payloads may hold the line too. Each
task emits its candidates with the offset of their successor, which the content
length tells. A place is known by its file and offset alone, since where files are
split may differ from one reading to the next. Pointer jumping from the start of each file keeps the candidates
on its chain: a round doubles the length of the jumps, so a file of n records
takes log2 n rounds of joins. Payloads that hold the line themselves are put
together again from their pieces, found by ranges of offsets; for them, the files
that hold such payloads are read a second time, each in one task.

Null payloads are empty. Null ids and addresses leave their header field out; a
record without an id is a response only if all equal payloads have none.
Repeated rows of one id and payload are told apart by nothing, so they share
their type. A payload is one value, so it may be as long as Spark's strings; very long ones are written and
read whole. Columns other than id, address and payload are not read, whatever their names. Line breaks in an address are dropped. Files without a record at
their start give no rows, and neither does an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import lookup, new_path, scratch, stage

MAGIC = "WARC/1.1\r\n"
CRLF = "\r\n"
GAP_BYTES = 4
#: Fixed value: the profile of revisits to an identical payload (ISO 28500).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "urn:page:"
#: Records of a range join are looked up by cells of so many bytes.
CELL = 65_536


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    parts = [(1, 15, 12), (16, 15, 12), (31, 10, 8)]
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, at, n), 16, 32), width, "0") for at, n, width in parts]), DIGITS, BASE32)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, date: str = "1970-01-01T00:00:00Z", records_a_file: int = 20_000, compression: str = "gzip", path: str | None = None) -> str:
    """Write an archive record for each page; returns the folder. ``compression``: a codec of Spark's text writer, or none."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    with scratch(spark):
        _write(pages, page_id, url, html, revisit_from, date, records_a_file, compression, path)
    return path


def _write(pages: DataFrame, page_id: str, url: str, html: str, revisit_from: int, date: str, records_a_file: int, compression: str, path: str) -> None:
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    sha = base32_sha1(F.col("html").cast("binary"))
    ids = stage(rows.where(F.octet_length("html") >= revisit_from).select("page_id", sha.alias("sha")), "digests")
    first = stage(ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first")
    again = lookup(ids, first, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to").distinct()
    full = rows.withColumn("sha", sha).withColumn("size", F.octet_length("html"))
    # the payload moves by page, never by digest: a popular payload stays spread out
    known = full.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.col("page_id").cast("string"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
        _line("X-Payload-Length", F.col("size").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF),
        body,
    )
    known.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_a_file).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the version line, with its file, and its block and order in this reading."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value"),
    )


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("header"), rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, next, header fields, ...): every place that may begin a record, and its successor."""
    head_end = CRLF + CRLF
    cut = _pieces(spark, path).withColumn("header", F.substring_index("value", head_end, 1))
    body_at = F.octet_length("header") + GAP_BYTES
    length = F.regexp_extract(F.col("header"), r"(?im)^Content-Length:[ \t]*(\d{1,15})[ \t]*\r?$", 1).try_cast("long")
    # where files are split is settled here: blocks and order mean nothing in another reading
    seen = stage(cut.select(
        "file",
        "block",
        "at",
        F.octet_length("value").cast("long").alias("size"),
        body_at.cast("long").alias("body_at"),
        length.alias("length"),
        _header("WARC-Type").alias("type"),
        _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Target-URI").alias("target_uri"),
        _header("WARC-Refers-To").alias("refers_to"),
        _header("WARC-Payload-Digest").alias("told_digest"),
        _header("X-Payload-Length").alias("told_length"),
        # the whole payload, if it ends inside the piece
        F.when(
            (length.isNotNull()) & (F.octet_length("value") >= body_at + length),
            base32_sha1(F.substring(F.col("value").cast("binary"), body_at + 1, length.cast("int"))),
        ).alias("sha"),
    ), "pieces")
    width = len(MAGIC)
    in_block = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("inside", F.coalesce(F.sum(F.col("size") + width).over(in_block), F.lit(0)))
    blocks = seen.groupBy("file", "block").agg(F.sum(F.col("size") + width).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    placed = placed.join(blocks, ["file", "block"]).withColumn("offset", F.col("base") + F.col("inside") - width)
    return placed.where("offset >= 0").withColumn("next", F.col("offset") + width + F.col("body_at") + F.col("length") + GAP_BYTES).drop("base", "inside", "block", "at")


def reachable(nodes: DataFrame, rounds_a_stage: int = 3) -> DataFrame:
    """(file, offset) of the candidates on the chain that starts at offset 0, by pointer jumping."""
    most = nodes.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    rounds = math.ceil(math.log2(most)) + 1 if most > 1 else 1
    state = nodes.where(F.col("next").isNotNull()).select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("on"))
    for k in range(rounds):
        ahead = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("further"))
        marked = state.where("on").select("file", F.col("jump").alias("offset"), F.lit(True).alias("hit"))
        state = (
            state.join(ahead, ["file", "jump"], "left")
            .join(marked, ["file", "offset"], "left")
            .select("file", "offset", F.col("further").alias("jump"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"))
        )
        if (k + 1) % rounds_a_stage == 0:
            state = stage(state, "jumps")
    return state.where("on").select("file", "offset")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, type, record_id, target_uri, refers_to, content_length, sha, told_digest, told_length) of each record.

    ``sha`` is the digest of the payload as read, ``told_digest`` what the header says.
    """
    with scratch(spark) as kept:
        found = stage(candidates(spark, path), "candidates")
        chain = stage(reachable(found), "chain")
        kept += [found, chain]
    chain = chain.withColumn("kept", F.lit(True))
    marked = found.join(chain, ["file", "offset"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    records = marked.where("kept")
    split = records.where(F.col("sha").isNull() & (F.col("length") > 0))
    whole = records
    if not split.isEmpty():
        joined = _assembled(spark, path, split, marked.where("not kept"))
        whole = records.join(joined, ["file", "offset"], "left").withColumn("sha", F.coalesce("sha", "joined_sha"))
    return whole.select("file", "offset", "type", "record_id", "target_uri", "refers_to", F.col("length").alias("content_length"), "sha", "told_digest", "told_length")


def _assembled(spark: SparkSession, path: str, split: DataFrame, inner: DataFrame) -> DataFrame:
    """Digests of payloads that hold the version line, from the pieces that lie in their range."""
    cells = split.select("file", F.col("offset").alias("record"), F.col("next").alias("end"), F.explode(F.sequence(F.floor(F.col("offset") / CELL), F.floor(F.col("next") / CELL))).alias("cell"))
    owned = inner.withColumn("cell", F.floor(F.col("offset") / CELL)).join(cells, ["file", "cell"]).where("offset > record and offset < end")
    parts = owned.select("file", "record", "offset").unionByName(split.select("file", F.col("offset").alias("record"), "offset"))
    before = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    again = _pieces(spark, path).join(split.select("file").distinct(), "file", "left_semi")
    sizes = F.sum(F.octet_length("value").cast("long") + len(MAGIC)).over(before)
    pieces = again.withColumn("offset", F.coalesce(sizes, F.lit(0)) - len(MAGIC)).join(parts, ["file", "offset"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda p: p["value"]), MAGIC)
    joined = pieces.groupBy("file", F.col("record").alias("offset")).agg(text.alias("value"))
    sized = joined.join(split.select("file", "offset", "body_at", "length"), ["file", "offset"])
    payload = F.substring(F.col("value").cast("binary"), (F.col("body_at") + 1).cast("int"), F.col("length").cast("int"))
    return sized.select("file", "offset", base32_sha1(payload).alias("joined_sha"))


def page_of(record_id: Column) -> Column:
    """The page id that a record id names."""
    return F.regexp_extract(record_id, f"<{ID}(-?\\d+)>", 1).try_cast("long")
