"""WARC files as tables, and revisit records completed from the response that they refer to.

A server that answers "not modified" leaves a revisit record without a body. Its page is the latest earlier full response of
the same canonical URL: an as-of join. Rows are cut into ranges by (URL, time), so that even one URL with very many captures
is spread over tasks; each range is walked through once, and what reaches over a cut is joined up from one row for each range.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.storage import stage

END = "\r\n\r\n"
CUT = END + "WARC/1."  # between records
UNNAMED = "\0unnamed:"  # before the numbers of records without an id
FIELD = "struct<name:string,value:string>"
# fixed values: fields of a 304 answer that never replace those of the stored response, and hop-by-hop fields
KEPT_FIELDS = ["content-encoding", "content-length", "content-md5", "content-range", "content-type", "content-location"]
HOP_FIELDS = ["connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
              "transfer-encoding", "upgrade"]
# fixed values: query parameters that do not choose a page
TRACKING = "utm_[^=&]*|gclid|fbclid|ref|sessionid|phpsessid|jsessionid"


def canonical(url: Column) -> Column:
    """A URL without scheme, "www", default port, fragment, tracking parameters and closing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^(?i:https?)://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(/index\.html?)?/*$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def fields(header: Column) -> Column:
    """Name and value of each line of a header, in order; names in lower case, folded lines joined."""
    lines = F.split(F.regexp_replace(header, r"\r?\n[ \t]+", " "), r"\r?\n")
    named = F.filter(lines, lambda x: x.contains(":"))
    return F.transform(named, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
        F.trim(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x))).alias("value")))


def value(all_fields: Column, name: str) -> Column:
    """The first value of a field; null without one."""
    return F.get(F.filter(all_fields, lambda f: f["name"] == name), F.lit(0))["value"]


def write(records: DataFrame, path: str) -> None:
    """Write records (record_id, type, url, date, extra, block) as WARC files; `extra` are further header lines (array of text).

    Null url, extra and block are left out or empty. The text writer ends each record with the two line ends that the format asks for.
    """
    block = F.coalesce("block", F.lit(""))
    lines = F.concat(
        F.array(F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), "type"),
                F.concat(F.lit("WARC-Record-ID: <"), "record_id", F.lit(">")),
                F.concat(F.lit("WARC-Date: "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        F.when(F.col("url").isNotNull(), F.array(F.concat(F.lit("WARC-Target-URI: "), "url"))).otherwise(F.array().cast("array<string>")),
        F.coalesce("extra", F.array().cast("array<string>")),
        F.array(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))))
    records.select(F.concat(F.array_join(lines, "\r\n"), F.lit(END), block).alias("value")).write.option("lineSep", END).text(path)


def _glued(batches):
    """Join the pieces of records that hold the record separator themselves: rows (file, place, piece) in file order."""
    import re

    def told(head):
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        return int(m[1]) if m else 0

    file, held, missing = None, [], 0

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["piece"])

    for batch in batches:
        rows = []
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if held and (name != file or missing <= 0):
                rows.append(CUT.encode().join(held))
                held = []
            if held:
                held.append(piece)
                missing -= len(piece) + len(CUT)
            else:
                head = piece.split(END.encode(), 1)[0]
                file, held, missing = name, [piece], told(head) - (len(piece) - len(head) - len(END))
        if rows:
            yield out(rows)
    if held:
        yield out([CUT.encode().join(held)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain or gzip): record_id, type, url, date, header, http_status, http, body.

    `header` and `http` are arrays of (name, value); http_status, http and body of a record that holds no HTTP message are null, empty
    and the block. Blocks are as long as their Content-Length says, or as the file goes. Files are split at
    record separators by Spark's text reader; records whose content holds a separator are joined up again, file by
    file in file order. An unreadable date is null; an empty file gives no records.
    """
    pieces = (spark.read.option("lineSep", CUT).text(path)
              .select(F.col("_metadata.file_path").alias("file"),
                      F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
                      F.col("value").cast("binary").alias("piece")))
    split_at = lambda c: F.length(F.substring_index(c.cast("string"), END, 1).cast("binary"))
    length = lambda head: F.regexp_extract(head, r"(?im)^content-length:[ \t]*(\d+)", 1).try_cast("long")
    head = F.substring_index(F.col("piece").cast("string"), END, 1)
    # too short, or not the beginning of a record
    short = (F.coalesce(length(head), F.lit(0)) > F.octet_length("piece") - split_at(F.col("piece")) - len(END))
    odd = pieces.where(short).select("file").distinct()
    if not odd.isEmpty():
        odd = stage(odd, "warc-odd")
        glued = (pieces.join(odd, "file", "left_semi").repartition("file").sortWithinPartitions("file", "place")
                 .mapInArrow(_glued, "piece binary"))
        pieces = pieces.join(odd, "file", "left_anti").select("piece").unionByName(glued)
    df = (pieces.withColumn("head", head).where(F.col("head").rlike("(?i)warc-type:"))
          .withColumn("header", fields(F.col("head")))
          .withColumn("size", F.coalesce(length(F.col("head")), F.lit(0)).cast("int"))
          .withColumn("block", F.expr(f"substring(piece, octet_length(head) + {len(END)} + 1, size)")))
    http = F.col("block").cast("string").startswith("HTTP/")
    df = df.withColumn("top", F.when(http, F.substring_index(F.col("block").cast("string"), END, 1)))
    name = value(F.col("header"), "warc-record-id")
    return df.select(
        F.regexp_replace(name, "^<|>$", "").alias("record_id"), F.lower(value(F.col("header"), "warc-type")).alias("type"),
        F.regexp_replace(value(F.col("header"), "warc-target-uri"), "^<|>$", "").alias("url"),
        value(F.col("header"), "warc-date").try_cast("timestamp").alias("date"), "header",
        F.regexp_extract("top", r"^HTTP/\S+ +(\d{3})", 1).try_cast("int").alias("http_status"),
        F.coalesce(fields(F.col("top")), F.array().cast(f"array<{FIELD}>")).alias("http"),
        F.when(http, F.expr(f"substring(block, octet_length(top) + {len(END)} + 1, size)"))
        .otherwise(F.col("block")).alias("body"))


def _as_of(batches):
    """Walk through captures sorted by (url, date), responses behind revisits of the same time, and give each revisit the last
    response of its URL in this range. The last row tells what the range leaves to the next one."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    url, first, base, schema = None, True, None, None
    for batch in batches:
        rows, bases, opens = [], [], []
        for k, (record, this, full) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                     batch.column(3).to_pylist(), strict=True)):
            if this != url:
                first = url is None
                url, base = this, None
            if full:
                base = record
            else:
                rows.append(k)
                bases.append(base)
                opens.append(base is None and first)
        n = len(rows)
        schema = True
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())),
             pa.array(bases, pa.string()), pa.array(opens, pa.bool_()), pa.array([part] * n, pa.int32()),
             pa.array([False] * n, pa.bool_())], ["record_id", "key", "base_id", "open", "part", "edge"])
    if schema and base is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.string()), pa.array([url], pa.string()), pa.array([base], pa.string()),
             pa.array([False]), pa.array([part], pa.int32()), pa.array([True])],
            ["record_id", "key", "base_id", "open", "part", "edge"])


def bases(records: DataFrame) -> DataFrame:
    """(record_id, base_id) of every revisit with a URL: the latest full response of its canonical URL strictly before it, or null.

    Of responses of one time, the one with the largest record_id counts.
    """
    full = (F.col("type") == "response") & (F.col("http_status") == 200)
    rows = (records.where(full | (F.col("type") == "revisit")).where("url is not null and date is not null")
            .select("record_id", canonical(F.col("url")).alias("key"), "date", full.alias("full")))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = stage(rows.repartitionByRange(parts, "key", "date", "full", "record_id")
                   .sortWithinPartitions("key", "date", "full", "record_id")
                   .mapInArrow(_as_of, "record_id string, key string, base_id string, open boolean, part int, edge boolean"),
                   "as-of")
    # one row for each range at most
    edges = walked.where("edge").groupBy("key").agg(F.collect_list(F.struct("part", "base_id")).alias("edges"))
    before = F.array_max(F.filter("edges", lambda e: e["part"] < F.col("part")))["base_id"]
    return walked.where("not edge").join(F.broadcast(edges), "key", "left").select(
        "record_id", F.when(F.col("open"), before).otherwise(F.col("base_id")).alias("base_id"))


def merged(old: Column, new: Column) -> Column:
    """Fields of a stored response after a 304 answer: permitted fields of the answer replace those of the same name."""
    allowed = F.filter(new, lambda f: ~f["name"].isin(KEPT_FIELDS + HOP_FIELDS))
    kept = F.filter(old, lambda f: ~F.exists(allowed, lambda g: g["name"] == f["name"]) & ~f["name"].isin(HOP_FIELDS))
    return F.concat(kept, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of `records` (see `read`): record_id, url, date, base_id, outcome, http, payload_sha256, payload_bytes.

    outcome: "etag" or "last-modified" names the validator that agrees with the latest earlier full response; "conflict" (a
    validator differs), "unverified" (no validator on both sides), "no base" (no earlier full response) and "no url" (no url
    or date) leave the revisit as it is: base_id, http and payload stay null; so does the base_id of a base without an id. Entity tags are compared weakly; Last-Modified counts only where
    a side lacks the tag. `http` are the merged fields. Of records that repeat a record_id, the earliest counts, then the
    smallest by type, url, status, digest and size (nulls first); records without a record_id are all kept. An empty table gives an empty result.
    """
    own = F.concat(F.lit(UNNAMED), F.monotonically_increasing_id().cast("string"))
    rows = records.where(F.col("type").isin("response", "revisit")).select(
        F.coalesce("record_id", own).alias("record_id"), F.col("date"), "type", "url", "http_status",
        F.sha2("body", 256).alias("payload_sha256"), F.octet_length("body").cast("long").alias("payload_bytes"), "http")
    first = F.min(F.struct(*rows.columns[1:])).alias("r")
    small = stage(rows.groupBy("record_id").agg(first).select("record_id", "r.*"), "captures")
    found = bases(small)
    full = small.where("type = 'response' and http_status = 200").select(
        F.col("record_id").alias("base_id"), F.col("http").alias("old"), "payload_sha256", "payload_bytes")
    df = (small.where("type = 'revisit'").select("record_id", "url", "date", F.col("http").alias("new"))
          .join(found, "record_id", "left").join(full, "base_id", "left"))
    tag = lambda c: F.regexp_replace(value(F.col(c), "etag"), "^W/", "")
    time = lambda c: value(F.col(c), "last-modified")
    outcome = (F.when(F.col("url").isNull() | F.col("date").isNull(), "no url").when(F.col("base_id").isNull(), "no base")
               .when(tag("old") == tag("new"), "etag").when(tag("old") != tag("new"), "conflict")
               .when(time("old") == time("new"), "last-modified").when(time("old") != time("new"), "conflict")
               .otherwise("unverified"))
    df = df.withColumn("outcome", outcome)
    good = F.col("outcome").isin("etag", "last-modified")
    named = lambda c: F.when(~F.col(c).startswith(UNNAMED), F.col(c))
    return df.select(named("record_id").alias("record_id"), "url", "date", F.when(good, named("base_id")).alias("base_id"), "outcome",
                     F.when(good, merged(F.col("old"), F.col("new"))).alias("http"),
                     *(F.when(good, F.col(c)).alias(c) for c in ("payload_sha256", "payload_bytes")))
