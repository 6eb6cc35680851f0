"""WARC archives: writing with revisits, and reading by a verified chain of records.

Archives are read in splits. Every place with a record's magic is a candidate, also
inside payloads. A candidate's header says where its successor begins; only what is
reached from the start of its file, successor by successor, is a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise, new_table

from .batches import table, text_bytes
from .linking import marked

MAGIC, LINE, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"

#: Payloads that are shorter are stored again rather than referred to.
LEAST_REVISIT = 1000

#: Records of a file; a longer archive goes on in another.
RECORDS = 8192

#: The date of all records: an archive of the same pages is the same.
DATE = "2000-01-01T00:00:00Z"


def _field(name: str, value: Column) -> Column:
    """A header line; none for null. Line ends in a value would break the header."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit(LINE)), F.lit(""))


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, payload, n, digest, refers_to``: of equal payloads of ``least`` bytes and
    more, all but those of the largest page id refer to that.

    Copies are counted by digest with map-side combine. Of the contents, those of pages
    that refer to others are shuffled, by page and never by digest; the rest is not.
    """
    rows = pages.withColumn("page_id", F.col("page_id").cast("bigint")).withColumns({"n": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    narrow = rows.select("page_id", "digest", "n").where((F.col("n") >= least) & F.col("page_id").isNotNull())
    kept = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_copies"))
    other = narrow.join(kept.where("_copies > 1"), ["digest", "n"]).where("page_id != refers_to")
    other = materialise(other.select("page_id", "digest", "refers_to").distinct())
    rows = marked(rows, other.select(F.col("page_id").alias("id")), "page_id")
    plain = rows.where("NOT _maybe").withColumn("refers_to", F.lit(None).cast("bigint"))
    again = rows.where("_maybe").join(other.hint("merge"), ["page_id", "digest"], "left")
    return plain.unionByName(again).drop("_maybe")


def records(pages: DataFrame) -> DataFrame:
    """``record``: each page's record without the blank line behind it."""
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"), _field("Content-Length", F.col("n")), F.lit(LINE))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC), _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", name("page_id")), _field("WARC-Date", F.lit(DATE)), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(again, name("refers_to"))),
        _field("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", length), F.lit(LINE),
    )
    payload = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    return pages.select(F.concat(head, http, payload).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``page_id, url, payload`` (binary) as WARC files, several records a task.

    The text writer puts the blank line of the format behind each record. Null
    payloads are empty; null URLs have no target line; a null page id is written ``-``
    and always a response; rows with one page id are records of their own.
    """
    plain = pages.withColumn("payload", F.coalesce("payload", F.lit(b"")))
    out = records(revisits(plain)).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS)
    out.text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, row, value``: what lies between places with the magic, as bytes. The
    text reader splits files; block and row give the order inside a file."""
    lines = spark.read.option("lineSep", MAGIC).schema("value string").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"),
    )


def _text_field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, f"(?im)^{name}:[ ]*(.*?)\r?$", 1)
    return F.when(found != "", found)


def parsed(pieces: DataFrame) -> DataFrame:
    """The narrow part of each candidate: header fields, sizes, and the digest of its
    payload where the record ends with it (``whole``)."""
    text = F.col("value").cast("string")
    head, both = F.substring_index(text, END, 1), F.substring_index(text, END, 2)
    rows = pieces.withColumns({"_head": head, "size": F.octet_length("value"), "_http_end": F.octet_length(both) + 4})
    rows = rows.withColumn("_block_at", F.octet_length("_head") + 4)
    length = _text_field(F.col("_head"), "Content-Length").cast("bigint")
    rows = rows.withColumns({"length": length, "type": _text_field(F.col("_head"), "WARC-Type")})
    http = F.substring(F.col("value"), F.col("_block_at") + 1, F.greatest(F.col("_http_end") - F.col("_block_at"), F.lit(0))).cast("string")
    rows = rows.withColumns({
        "page_id": F.regexp_extract(_text_field(F.col("_head"), "WARC-Record-ID"), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint"),
        "refers_to": F.regexp_extract(_text_field(F.col("_head"), "WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint"),
        "stated": F.regexp_extract(_text_field(F.col("_head"), "WARC-Payload-Digest"), "^sha1:([0-9a-f]+)$", 1),
        "bytes": _text_field(http, "Content-Length").cast("bigint"),
        "payload_at": F.col("_http_end"),
        "record": len(MAGIC) + F.col("_block_at") + F.col("length") + 4,
    })
    whole = F.coalesce(F.col("record") == F.col("size") + len(MAGIC), F.lit(False))
    payload = F.substring(F.col("value"), F.col("payload_at") + 1, F.greatest(F.col("size") - 4 - F.col("payload_at"), F.lit(0)))
    rows = rows.withColumns({"whole": whole, "digest": F.when(whole & (F.col("type") == "response"), F.sha1(payload))})
    return rows.select(
        "file", "block", "row", "size", "record", "whole", "type", "page_id", "refers_to", "stated", "bytes", "payload_at", "digest"
    )


def placed(pieces: DataFrame) -> DataFrame:
    """Adds ``at``, where a piece's magic stands in its file; null for what is before the first."""
    order = Window.partitionBy("file").orderBy("block", "row")
    before = F.coalesce(F.sum(F.col("size").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(order)
    return pieces.withColumn("at", F.when(place > 1, before + len(MAGIC) * (place - 2)))


def chain(found: DataFrame) -> DataFrame:
    """The candidates that are reached from the start of their file.

    Candidates that follow each other without a gap form runs; a run begins anew where
    some other candidate points. Runs point at runs: the set of runs reached from
    offset 0 doubles its length each round, while every pointer jumps to its
    target's target. Only counts reach the driver.
    """
    order = Window.partitionBy("file").orderBy("at")
    edges = found.select("file", "at", (F.col("at") + F.col("record")).alias("next"))
    edges = edges.withColumns({"_before": F.lag("next").over(order), "_following": F.lead("at").over(order)})
    jumps = edges.where(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("_following")))
    targets = jumps.select("file", F.col("next").alias("at"), F.lit(True).alias("_target")).distinct()
    opened = edges.join(targets, ["file", "at"], "left")
    starts = ~F.col("at").eqNullSafe(F.col("_before")) | F.col("_target").isNotNull()
    head = F.max(F.when(starts, F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = materialise(opened.select("file", "at", "next", head.alias("head")))
    # A run's last candidate leaves it; within a run offsets and successors grow together.
    pointer = materialise(runs.groupBy("file", "head").agg(F.max_by("next", "at").alias("to")))
    reached = materialise(pointer.where("head = 0").select("file", "head"))
    n = reached.count()
    while True:
        step = pointer.join(reached, ["file", "head"], "left_semi").select("file", F.col("to").alias("head"))
        step = step.join(pointer.select("file", "head"), ["file", "head"], "left_semi")
        more = materialise(reached.union(step).distinct())
        count = more.count()
        discard(reached)
        reached = more
        if count == n:
            break
        n = count
        onward = pointer.select("file", F.col("head").alias("to"), F.col("to").alias("_onward"))
        farther = materialise(pointer.join(onward, ["file", "to"], "left").select("file", "head", F.col("_onward").alias("to")))
        discard(pointer)
        pointer = farther
    good = runs.join(reached, ["file", "head"], "left_semi").select("file", "at")
    return found.join(good, ["file", "at"], "left_semi")


def gathered(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """``file, at, digest, bytes`` of records whose payload holds the magic, put together
    from all their pieces. Only files with such records are read again."""
    files = broken.select("file").distinct()
    pieces = candidates(spark, path).join(files, "file", "left_semi").withColumn("size", F.octet_length("value"))
    pieces = placed(pieces).where(F.col("at").isNotNull())
    owner = broken.select("file", "at", F.col("at").alias("start"), (F.col("at") + F.col("record")).alias("stop"), "length", "skip")
    # A piece belongs to the record that began last before it.
    marks = pieces.join(owner, ["file", "at"], "left")
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("start").isNotNull(), F.struct("start", "stop", "skip", "length")), ignorenulls=True).over(order)
    mine = marks.withColumn("_own", last).where("_own IS NOT NULL AND at < _own.stop")
    parts = mine.groupBy("file", F.col("_own").alias("own")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"].cast("string")), MAGIC).cast("binary")
    payload = F.substring(joined, F.col("own.skip") + 1, F.col("own.length"))
    return parts.select("file", F.col("own.start").alias("at"), F.sha1(payload).alias("_digest"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` of each record.

    The digest of a response is that of its stored payload (``intact``: it is the one
    in its header), that of a revisit the one in its header; sizes are those of the
    HTTP header. Magic inside payloads makes candidates that no chain reaches. Files
    that are empty or have no record at their start give no rows.
    """
    found = materialise(placed(parsed(candidates(spark, path))).where(F.col("at").isNotNull()))
    good = materialise(chain(found))
    skip, length = F.col("payload_at"), F.col("record") - len(MAGIC) - 4 - F.col("payload_at")
    broken = good.where("NOT whole AND type = 'response'").select("file", "at", "record", length.alias("length"), skip.alias("skip"))
    rows = good
    if not broken.isEmpty():
        rest = gathered(spark, path, broken)
        rows = good.join(rest, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "_digest"))
    digest = F.when(F.col("type") == "response", F.col("digest")).otherwise(F.col("stated"))
    return rows.select(
        "page_id", F.col("bytes").alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to", (digest == F.col("stated")).alias("intact"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table(spark)
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", text_bytes("html").alias("payload")), path)
    return read_archives(spark, path)


SQL = f"""WITH payloads AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
kept AS (SELECT digest, n, max(page_id) AS keeper FROM payloads WHERE n >= {LEAST_REVISIT} GROUP BY digest, n),
joined AS (SELECT p.*, CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to FROM payloads p LEFT JOIN kept k USING (digest, n))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, true AS intact
FROM joined"""
