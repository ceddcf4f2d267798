"""Attachments: files, their text, pages and segments, and storage rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = 1600
CHUNK = 1 << 20
WINDOW = 4096


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, sha256) of the files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Files whose length and hash equal the declared ones (path, length, sha256)."""
    return files.join(declared, ["path", "length", "sha256"], "left_semi")


def file_text(content: Column) -> Column:
    """UTF-8 text without a byte order mark and with plain line ends; null where the bytes aren't UTF-8."""
    text = F.regexp_replace(F.decode(content, "utf-8"), "^\ufeff", "")
    return F.when(F.is_valid_utf8(content), F.replace(text, F.lit("\r\n"), F.lit("\n")))


def byte_range(content: Column, offset: int, length: int) -> Column:
    """At most 1 MiB of the bytes from ``offset``."""
    return F.substring(content, offset + 1, min(length, CHUNK))


def page_window(pages: DataFrame, offset: int, chars: int) -> DataFrame:
    """``pages`` (id, text) as (id, window, eof): at most 4,096 characters from ``offset``."""
    n = min(chars, WINDOW)
    return pages.select("id", F.substring("text", offset + 1, n).alias("window"), (F.length("text") <= offset + n).alias("eof"))


def segments(pages: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(id, chunk_index, segment): each text in pieces of ``size`` characters; an empty text has none."""
    last = F.ceil(F.length("text") / size).cast("int") - 1
    parts = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("text"), i * size + 1, F.lit(size))))
    return pages.select("id", F.posexplode(parts).alias("chunk_index", "segment")).select("id", F.col("chunk_index").cast("long"), "segment")


def storage_used(files: DataFrame, reservations: DataFrame, now: int) -> DataFrame:
    """(owner, used): bytes of stored files and of reservations that have not expired at ``now``."""
    live = reservations.filter(F.col("expires") > now).select("owner", "bytes")
    return files.select("owner", "bytes").union(live).groupBy("owner").agg(F.sum("bytes").alias("used"))


def allowed_type(mime: Column, patterns: list[str]) -> Column:
    """Whether a MIME type is listed, where ``type/*`` allows a whole class."""
    test = F.lit(False)
    for p in patterns:
        test |= mime.startswith(p[:-1]) if p.endswith("/*") else mime == p
    return F.coalesce(test, F.lit(False))


# Fixed value: life of an upload session without a chunk, in microseconds.
UPLOAD_LIFE = 3_600_000_000


def upload_faults(new: DataFrame, attachment: DataFrame, entity: DataFrame, patterns: list[str], most_bytes: int) -> DataFrame:
    """(pos, fault) of the files ``new`` (pos, entity_id, filename, mime, bytes) that are refused, by the first rule broken.

    No file name; a MIME type that isn't listed; a size below 0 or too large; no such
    entity; a file name that the entity has already, or that an earlier row gives it.
    """
    held = attachment.select("entity_id", "filename", F.lit(True).alias("held")).distinct()
    known = entity.select(F.col("id").alias("entity_id"), F.lit(True).alias("known"))
    rows = new.join(held, ["entity_id", "filename"], "left").join(known, "entity_id", "left")
    fault = F.when(F.trim(F.coalesce("filename", F.lit(""))) == "", "filename").when(~allowed_type(F.col("mime"), patterns), "mime").when(~F.coalesce(F.col("bytes").between(0, most_bytes), F.lit(False)), "size").when(F.col("known").isNull(), "entity").when(F.col("held").isNotNull(), "duplicate")
    rows = rows.withColumn("fault", fault)
    turn = F.row_number().over(Window.partitionBy("entity_id", "filename", F.col("fault").isNull()).orderBy("pos"))
    return rows.select("pos", F.when(F.col("fault").isNull() & (turn > 1), "duplicate").otherwise(F.col("fault")).alias("fault")).filter("fault IS NOT NULL")


def live_uploads(uploads: DataFrame, chunks: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(uploads, chunks) without sessions (upload_id, touched, ...) that had no chunk for an hour, and their chunks (upload_id, ...)."""
    live = uploads.filter(F.col("touched") + UPLOAD_LIFE > now)
    return live, chunks.join(live.select("upload_id"), "upload_id", "left_semi").select(chunks.columns)


def complete_uploads(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """(upload_id, complete): uploads (upload_id, bytes) whose chunks (upload_id, offset, bytes) follow without gap up to the end.

    Chunks sent again with equal place and size count once.
    """
    once = chunks.select("upload_id", "offset", "bytes").distinct()
    # Without gap or overlap: each end but the last is a start, and sizes add up.
    ends = once.select("upload_id", (F.col("offset") + F.col("bytes")).alias("offset"))
    followed = ends.join(once.select("upload_id", "offset"), ["upload_id", "offset"], "left_semi").groupBy("upload_id").agg(F.count(F.lit(1)).alias("f"))
    sums = once.groupBy("upload_id").agg(F.sum("bytes").alias("total"), F.min("offset").alias("low"), F.count(F.lit(1)).alias("n"))
    rows = declared.join(sums, "upload_id", "left").join(followed, "upload_id", "left")
    ok = (F.col("low") == 0) & (F.col("total") == F.col("bytes")) & (F.coalesce("f", F.lit(0)) == F.col("n") - 1)
    return rows.select("upload_id", F.coalesce(ok, F.lit(False)).alias("complete"))


def entity_documents(entity: DataFrame, observation: DataFrame) -> DataFrame:
    """(owner_id, kind, chunk_index, text): identity chunk and one chunk an observation."""
    identity = entity.select(F.col("id").alias("owner_id"), F.lit("identity").alias("kind"), F.lit(0).alias("chunk_index"), F.concat_ws("\n", "name", "entity_type").alias("text"))
    bodies = observation.select(F.col("entity_id").alias("owner_id"), F.lit("observation").alias("kind"), F.col("idx").alias("chunk_index"), F.col("body").alias("text"))
    return identity.union(bodies)


def relation_documents(mirror: DataFrame, entity: DataFrame, relation_observation: DataFrame) -> DataFrame:
    """(owner_id, kind, chunk_index, text): one chunk for each live relation of ``mirror`` (relation_id, triple, deleted): names of its ends, type and bodies in order."""
    end = lambda c: entity.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    triple = ["from_id", "to_id", "relation_type"]
    bodies = relation_observation.groupBy(*triple).agg(F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("o"))
    rows = mirror.filter("NOT deleted").join(end("from"), "from_id").join(end("to"), "to_id").join(bodies, triple, "left")
    lines = F.concat(F.array("from_name", "relation_type", "to_name"), F.coalesce(F.transform("o", lambda x: x["body"]), F.array().cast("array<string>")))
    return rows.select(F.col("relation_id").alias("owner_id"), F.lit("relation").alias("kind"), F.lit(0).alias("chunk_index"), F.array_join(lines, "\n").alias("text"))


def attachments_of(attachment: DataFrame, entity: DataFrame, name: str) -> DataFrame:
    """Attachments (attachment_id, entity_id, ...) of the entity of this name, by id."""
    owner = entity.filter(F.col("name") == name).select(F.col("id").alias("entity_id"))
    return attachment.join(owner, "entity_id", "left_semi").select(attachment.columns).orderBy("attachment_id")


def get_attachment(attachment: DataFrame, entity: DataFrame, attachment_id: int) -> DataFrame:
    """The attachment of this id with the name of its entity; nothing if either is gone."""
    rows = attachment.filter(F.col("attachment_id") == attachment_id)
    return rows.join(entity.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name")), "entity_id").select(*attachment.columns, "entity_name")


def delete_attachments(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table (attachment_id, ...) without the rows of ``gone`` (attachment_id): text, pages, chunks, vectors and jobs go too."""
    ids = gone.select("attachment_id")
    return {name: rows.join(ids, "attachment_id", "left_anti").select(rows.columns) for name, rows in tables.items()}
