r"""WARC archives written and read by Spark's own text source.

Writing: a record is one string, and Spark's text writer ends it with the two line ends that close a WARC record, so
the files are plain WARC 1.1 in any store that Spark can write. Reading: the text reader splits files at the magic
``WARC/1.1\r\n`` with byte ranges as tasks. Each piece is a candidate record; its header gives the offset of its
successor. The magic may also stand inside a payload, so only candidates that can be reached from the start of their
file by pointer jumping are records, and the other pieces are given back to the payload that holds them.

Defined results: a null html is an empty payload; a null id is written as the word null and read back as null; where
the least id of a payload occurs in several rows, all of them are responses; if all ids of a payload are null, all its
rows are responses; a payload may hold the magic, whole records or anything else; a file that doesn't start with the
magic has no record; a record cut off at the end of a file is dropped; an empty table gives an archive without
records; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdnet.scratch import Scratch

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Digits of base 32 as conv() writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A table of repeated payloads with more rows than this is joined by a shuffle.
BROADCAST_ROWS = 100_000
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: every 5 hex digits are 4 digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """One record a row; of equal payloads of least_bytes or more, all but that with the smallest id are revisits."""
    d = pages.select(F.col(page_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    d = d.withColumn("bytes", F.octet_length("html")).withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    again = d.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d2"), "first")
    again = Scratch(pages.sparkSession).cut(again, "repeated")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    d = d.join(again, (F.col("digest") == F.col("d2")) & (F.col("bytes") >= least_bytes), "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    fields = F.concat(
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\r\n]", ""), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"),
    )
    record = F.concat(F.lit(MAGIC), fields, F.lit(GAP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    d.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}: *([^\r\n]*)", 1)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, body, end): what follows each magic, the offset of that magic and the offset of the body's end.

    A split's pieces tile the file up to the first piece of the next split, so a split starts where the sizes of those
    before it end; within a split, rows come in order.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("body"))
    return raw.withColumn("size", F.octet_length("body").cast("long") + len(MAGIC))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, id, refers_to, digest, payload) of the records of all files in path; payload is binary.

    Only offsets are shuffled. A payload is taken from its own piece; the pieces for which that isn't enough are listed
    and broadcast, or joined by a shuffle if there are more than BROADCAST_ROWS of them.
    """
    scratch = Scratch(spark)
    raw = pieces(spark, path)
    has_head = F.locate(GAP, F.col("text")) > 0
    raw = raw.withColumn("text", F.decode("body", "ISO-8859-1")).withColumn("head", F.when(has_head, F.concat(F.substring_index("text", GAP, 1), F.lit("\r\n"))))
    length = F.expr("try_cast(" + r"regexp_extract(head, '(?im)^Content-Length: *([0-9]+)', 1)" + " as long)")
    raw = raw.select("file", F.xxhash64("file").alias("fid"), "block", "row", "size", "body", F.length("head").cast("long").alias("head_size"), length.alias("length"), _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("id"), _field("WARC-Refers-To").alias("refers_to"), F.regexp_extract(_field("WARC-Payload-Digest"), "^(?:sha1:)?(.*)$", 1).alias("digest"))
    stored = scratch.path("pieces")
    raw.write.option("compression", "zstd").parquet(stored)
    raw = spark.read.schema(raw.schema).parquet(stored)

    # from here on a file is the hash of its name, which is shorter to shuffle
    ids = raw.select(F.col("fid").alias("file"), "block", "row", "size", "head_size", "length")
    splits = ids.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("start"))
    in_split = F.sum("size").over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    # the piece before the first magic is what a file starts with instead of a magic: empty in a sound file
    light = ids.withColumn("inside", F.coalesce(in_split, F.lit(0)))
    light = light.join(splits, ["file", "block"]).withColumn("at", F.col("start") + F.col("inside") - len(MAGIC))
    ends = F.col("at") + len(MAGIC) + F.col("head_size") + len(GAP) - 2 + F.col("length")
    light = light.select("file", "block", "row", "at", "size", ends.alias("content_end"), (ends + len(GAP)).alias("next"))
    light = scratch.cut(light, "offsets")

    kept = scratch.cut(_reachable(light.select("file", "at", "next"), scratch), "records")
    cut_off = light.groupBy("file").agg(F.max(F.col("at") + F.col("size")).alias("file_end"))
    marks = light.join(kept.withColumn("kept", F.lit(True)), ["file", "at"], "left").join(cut_off, "file")
    marks = scratch.cut(marks.withColumn("mark", F.when(F.col("kept"), F.struct("at", "row", "content_end"))), "marks")
    # the record before a piece is in its own split, or else the last one of a split before that: a row for each split
    lasts = marks.groupBy("file", "block").agg(F.max("mark").alias("last"))
    earlier = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    lasts = lasts.select("file", "block", earlier.alias("earlier"))
    inside = F.last("mark", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("at"))
    marks = marks.withColumn("inside", inside).join(lasts, ["file", "block"]).withColumn("owner", F.coalesce("inside", "earlier"))
    held = F.col("owner").isNotNull() & (F.col("owner.content_end") <= F.col("file_end"))
    alone = F.coalesce(held & (F.col("owner.row") == F.col("row")) & (F.col("content_end") <= F.col("at") + F.col("size")), F.lit(False))
    # pieces that aren't a record with its whole payload: owner_row is null for those that belong to no record
    odd = marks.filter(~alone).select(F.col("file").alias("f"), F.col("row").alias("r"), F.col("at").alias("piece_at"), F.when(held, F.col("owner.row")).alias("owner_row"), F.when(held, F.col("owner.at")).alias("at"))
    odd = scratch.cut(odd, "odd")
    if odd.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        odd = F.broadcast(odd)
    same = (F.col("f") == F.col("fid")) & (F.col("r") == F.col("row"))
    start = (F.col("head_size") + len(GAP) - 2 + 1).cast("int")
    names = ["file", "type", "id", "refers_to", "digest"]
    plain = raw.filter("head_size IS NOT NULL").join(odd, same, "left_anti").select(*names, F.substring("body", start, F.col("length").cast("int")).alias("payload"))
    joined = raw.join(odd.filter("owner_row IS NOT NULL"), same)
    # a payload that holds the magic is in several pieces
    magic = F.encode(F.lit(MAGIC), "UTF-8")
    rest = joined.filter("r <> owner_row").groupBy("fid", "at").agg(F.sort_array(F.collect_list(F.struct("piece_at", "body"))).alias("more"))
    rest = rest.select(F.col("fid").alias("f2"), F.col("at").alias("at2"), F.aggregate("more", F.encode(F.lit(""), "UTF-8"), lambda s, x: F.concat(s, magic, x["body"])).alias("more"))
    whole = joined.filter("r = owner_row").join(rest, (F.col("fid") == F.col("f2")) & (F.col("at") == F.col("at2")))
    return plain.union(whole.select(*names, F.substring(F.concat("body", "more"), start, F.col("length").cast("int")).alias("payload")))


def _reachable(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at) of the candidates on the chain from offset 0 of each file, by pointer jumping."""
    links = links.filter("at >= 0 AND next IS NOT NULL").select("file", "at", "next")
    starts = links.filter("at = 0").select("file", "at")
    jumps, kept = links.join(links.select("file", F.col("at").alias("next")), ["file", "next"], "left_semi").select("file", "at", "next"), starts
    while True:
        jumps = scratch.cut(jumps, "jumps")
        new = kept.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        after = scratch.cut(kept.union(new).distinct(), "kept")
        far = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("to"))
        jumps = jumps.join(far, ["file", "next"]).select("file", "at", F.col("to").alias("next"))
        kept = after
        if new.isEmpty():
            return kept


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as long)")
    r = Scratch(spark).cut(records.select(page("id").alias("page_id"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "digest", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("read_digest")), "read")
    full = r.filter("record_type = 'response'").select(F.col("read_digest").alias("digest"), F.col("bytes").alias("full_bytes")).distinct()
    out = r.filter("record_type = 'revisit'").join(full, "digest").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return r.filter("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).union(out)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(8), lambda k: list_reduce(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31) + 1 AS BIGINT), 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM f
"""
