"""WARC archives: writing with payload revisits, and reading by boundary chains.

Writing: one record per page through Spark's text writer, whose line separator is
the blank line that ends a record; Spark's committer makes lost tasks harmless.

Reading: the text reader splits archives at the version mark that opens each
record, of version 1.0 or 1.1. Every piece is a candidate record with an offset, and its header names its
successor's offset. Candidates that stand inside a payload are told from records
by pointer jumping over runs of candidates that each name the following one: from the
start of each file, jumps of doubling length reach all true runs in a logarithmic number of
rounds, one if no payload holds the version mark. A record whose payload holds it has its
pieces joined again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, shared_dir, table

MAGIC = "WARC/1.1\r\n"
#: The part of the version line that both versions share.
MARK = "WARC/1."
END = "\r\n\r\n"
LEAST_BYTES = 100
RECORDS_PER_FILE = 2000


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(value): a WARC record, without its closing blank line, for each row of ``pages``.

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id keeps
    the payload and the others revisit it. A null html is an empty payload; a null
    url writes no target; a null page_id writes an empty id and never is the smallest.
    """
    page = F.col("page_id").cast("long")
    rows = pages.select(page.alias("page_id"), F.regexp_replace(F.col("url").cast("string"), "[\r\n]", "").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    # Payloads that occur once need no partner: the joined side holds repeated ones only.
    first = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    ident = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", ident), _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write gzip-compressed archives of bounded size under ``path``."""
    records(pages, least_bytes).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Candidates: text between version marks, with file, split and place in it."""
    raw = spark.read.option("lineSep", MARK).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))


def _parsed(df: DataFrame) -> DataFrame:
    """Header fields and payload measures of each candidate in column ``value``."""
    head = F.substring_index("value", END, 1)
    http = F.substring_index(F.substring_index("value", END, 2), END, -1)

    def field(where, name, pattern):
        return F.nullif(F.regexp_extract(where, f"(?i)(?:^|\r\n){name}: *{pattern}", 1), F.lit(""))

    df = df.withColumns({"head_bytes": F.octet_length(head).cast("long"), "http_bytes": F.octet_length(http).cast("long"), "piece_bytes": F.octet_length("value").cast("long"), "block_bytes": field(head, "Content-Length", "([0-9]{1,15})").cast("long")})
    payload = F.expr("substring(CAST(value AS BINARY), CAST(head_bytes + http_bytes + 9 AS INT), CAST(block_bytes - http_bytes - 4 AS INT))")
    return df.withColumns({
        "record_type": field(head, "WARC-Type", "([a-z]+)"), "page_id": field(head, "WARC-Record-ID", "<urn:page:(-?[0-9]{1,19})>").try_cast("long"),
        "refers_to": field(head, "WARC-Refers-To", "<urn:page:(-?[0-9]{1,19})>").try_cast("long"), "named_digest": field(head, "WARC-Payload-Digest", "sha256:([0-9a-f]{64})"),
        "named_bytes": field(http, "Content-Length", "([0-9]{1,15})").cast("long"), "read_bytes": F.octet_length(payload).cast("long"), "read_digest": F.sha2(payload, 256),
    })


def reachable(chain: DataFrame) -> DataFrame:
    """(file, at): offsets of ``chain`` (file, at, next) reached from offset 0 by pointer jumping.

    ``next`` must be greater than ``at``; a null one ends a chain. Files whose end is
    reached take no part in further rounds.
    """
    state = durable(chain.select("file", "at", "next", (F.col("at") == 0).alias("seen"), F.col("next").isNull().alias("last")), "chain")
    done = None
    while True:
        ended = state.filter("seen AND last").select("file").distinct()
        found = state.join(ended, "file", "left_semi").filter("seen").select("file", "at")
        done = found if done is None else done.union(found)
        state = state.join(ended, "file", "left_anti")
        if state.filter("next IS NOT NULL").isEmpty():
            return done
        ahead = state.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        marks = state.filter("seen").select("file", F.col("next").alias("at"), F.lit(True).alias("mark")).filter("at IS NOT NULL").distinct()
        moved = state.join(ahead, ["file", "next"], "left").join(marks, ["file", "at"], "left")
        state = durable(moved.select("file", "at", F.col("far").alias("next"), (F.col("seen") | F.coalesce("mark", F.lit(False))).alias("seen"), "last"), "chain")


def in_runs(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``placed`` (file, at, next and others) with column ``run``, and the chain of runs (file, at, next).

    A run is a stretch of candidates that each name the following one, called by its first offset.
    One that is named from elsewhere opens a run, so that a run is reached as a whole or not at all.
    """
    order = Window.partitionBy("file").orderBy("at")
    near = durable(placed.withColumns({"following": F.lead("at").over(order), "open": ~F.coalesce(F.lag("next").over(order) == F.col("at"), F.lit(False))}), "placed")
    far = near.filter("NOT next <=> following").select("file", F.col("next").alias("at")).filter("at IS NOT NULL").distinct().withColumn("far", F.lit(True))
    opened = near.join(far, ["file", "at"], "left").withColumn("open", F.col("open") | F.coalesce("far", F.lit(False)))
    run = F.max(F.when(F.col("open"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = durable(opened.withColumn("run", run).drop("open", "far", "following"), "runs")
    ends = runs.groupBy("file", "run").agg(F.max("at").alias("tail")).withColumnRenamed("run", "at")
    links = ends.join(runs.select("file", F.col("at").alias("tail"), "next"), ["file", "tail"]).select("file", "at", "next")
    known = ends.select("file", F.col("at").alias("next"), F.col("at").alias("there"))
    return runs, links.join(known, ["file", "next"], "left").select("file", "at", F.col("there").alias("next"))


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record under ``path``.

    The digest and size of a response are taken from the payload read, those of a
    revisit from its headers. A folder with no record gives no rows. A file whose chain of
    records doesn't lead from its start to its end (a torn file, a length that can't be
    read) raises an error, or, if not ``strict``, gives the records before the break.
    """
    light = durable(_parsed(_pieces(spark, path)).drop("value"), "pieces")
    order = Window.partitionBy("file", "split").orderBy("place")
    splits = light.groupBy("file", "split").agg(F.sum(F.col("piece_bytes") + len(MARK)).alias("all"))
    base = splits.withColumn("base", F.coalesce(F.sum("all").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    before = F.coalesce(F.sum(F.col("piece_bytes") + len(MARK)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A piece follows the version mark that opens it.
    placed = light.withColumn("before", before).join(base, ["file", "split"]).withColumn("at", F.col("before") + F.col("base") - len(MARK)).filter("at >= 0")
    placed = placed.withColumn("next", F.col("at") + len(MARK) + F.col("head_bytes") + len(END) + F.col("block_bytes") + len(END))
    placed, chain = in_runs(placed)
    true = reachable(chain).select("file", F.col("at").alias("run"), F.lit(True).alias("true"))
    found = placed.join(true, ["file", "run"], "left")
    if strict:
        ends = found.filter(F.col("true")).groupBy("file").agg(F.max("next").alias("end"))
        torn = splits.groupBy("file").agg((F.sum("all") - len(MARK)).alias("bytes")).join(ends, "file", "left").filter("bytes > 0 AND NOT bytes <=> end")
        first = torn.select("file").first()
        if first:
            raise ValueError(f"chain of records breaks in {first['file']}")
    whole = F.col("at") + len(MARK) + F.col("piece_bytes") == F.col("next")
    fields = ["page_id", F.when(F.col("record_type") == "revisit", F.col("named_bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"), F.when(F.col("record_type") == "revisit", F.col("named_digest")).otherwise(F.col("read_digest")).alias("payload_digest"), "record_type", "refers_to"]
    out = found.filter(F.col("true") & whole).select(*fields)
    broken = found.filter(F.col("true") & ~whole)
    if broken.isEmpty():
        return out
    # Records whose payload holds the version mark: their pieces, and only theirs, are joined.
    owner = F.last(F.when(F.col("true"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    parts = found.withColumn("owner", owner).join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi").select("file", "place", "at", "owner")
    joined = _pieces(spark, path).join(parts, ["file", "place"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))
    joined = joined.select(F.array_join(F.transform("all", lambda x: x["value"]), MARK).alias("value"))
    return out.union(_parsed(joined).select(*fields))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""
