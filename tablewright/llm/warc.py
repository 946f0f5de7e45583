"""WARC archives, written and read with boundary-chain verification.

Writing makes one record per row in plain-text part files; equal payloads of
``MIN_REVISIT`` bytes and more are stored once, as the response with the largest
id, and the others are revisits that refer to it.

Reading cuts the files at the record magic, in whatever splits Spark makes of
them. A piece's header names its successor's offset; a magic inside a payload makes a
piece that is no record. A chain of pieces whose successor is just the next
piece is one run; runs point to the run that holds their exit, and pointer
jumping from the file's start, in a number of rounds logarithmic in the
broken links, keeps the pieces that are reached. The other
pieces belong to the payload of the record before them. Only headers and
digests are kept on the way; a payload that spans pieces is read again, and if the
second scan's splits differ, so that it does not come out whole, the read fails.

Defined results: a null payload is empty; equal rows with the largest id are all
responses; a null id is below every id; a record whose end lies past the file's end
is left out, and so is what follows a broken header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import keep
from tablewright.names import quote_ident

MIN_REVISIT = 1_000
#: Records per file; bounds the archives' size.
FILE_RECORDS = 20_000
BROADCAST_ROWS = 200_000
# The format's magic (before the minor version), line and record ends, and the profile of revisits.
MAGIC, LINE, END = "WARC/1.", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(LINE))


def write(df: DataFrame, path: str, record_id: str, url: str, payload: str) -> None:
    """One record per row of ``df`` under ``path``."""
    body = F.coalesce(F.col(quote_ident(payload)), F.lit(""))
    rows = df.select(F.col(quote_ident(record_id)).alias("id"), F.coalesce(F.col(quote_ident(url)), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body"), "digest": F.sha1("body")})
    large = rows.filter(F.col("bytes") >= MIN_REVISIT).select("id", "digest")
    copied = keep(large.groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "original"), "warc")
    rows = rows.join(F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied, "digest", "left")
    revisit = (F.col("bytes") >= MIN_REVISIT) & F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")

    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    common = [_line("WARC-Record-ID", name("id")), _line("WARC-Date", DATE), _line("WARC-Target-URI", uri), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _line("Content-Type", "text/html")]
    whole = F.concat(F.lit(f"{MAGIC}1{LINE}"), _line("WARC-Type", "response"), *common, _line("Content-Length", F.col("bytes").cast("string")), F.lit(LINE), F.col("body"))
    again = F.concat(F.lit(f"{MAGIC}1{LINE}"), _line("WARC-Type", "revisit"), *common, _line("WARC-Profile", PROFILE), _line("WARC-Refers-To", name("original")), _line("X-Payload-Length", F.col("bytes").cast("string")), _line("Content-Length", "0"), F.lit(LINE))
    rows.select(F.when(revisit, again).otherwise(whole).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, piece, body``: what lies between two magics; pieces count on within a block."""
    cut = spark.read.option("lineSep", MAGIC).text(path)
    return cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"), F.col("value").alias("body"))


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _payload_digest(body: Column, head: Column, length: Column) -> Column:
    """The SHA-1 of the whole payload, if the body holds it and the record's end exactly."""
    rest = F.octet_length(body) - F.octet_length(head)
    payload = F.substr(body, F.length(head) + 1, F.length(body) - F.length(head) - len(END))
    return F.when((rest == length + len(END)) & F.endswith(body, F.lit(END)), F.sha1(payload))


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its offset, and the successor that its header names."""
    pieces = _pieces(spark, path)
    at = F.instr("body", END)
    # a header begins with the rest of the version and has a blank line
    head = F.when((at > 0) & F.rlike("body", F.lit(r"^\d\r\n")), F.substr("body", F.lit(1), at + (len(END) - 1)))
    found = pieces.withColumn("head", head)
    length = _field(F.col("head"), "Content-Length").try_cast("long")
    found = found.withColumns({"length": length, "bytes": F.octet_length("body").cast("long"), "head_bytes": F.octet_length("head")})
    found = found.select(
        "file", "block", "piece", "bytes", "length", "head_bytes",
        F.lower(_field(F.col("head"), "WARC-Type")).alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("target_uri"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "(?i)^sha1:", "").alias("stated_digest"),
        _field(F.col("head"), "X-Payload-Length").try_cast("long").alias("stated_length"),
        _payload_digest(F.col("body"), F.col("head"), F.col("length")).alias("digest"),
    )
    found = keep(found, "warc")
    # the pieces tile the file, so offsets are running sums: over blocks, and within each
    tile = F.col("bytes") + len(MAGIC)
    blocks = found.groupBy("file", "block").agg(F.sum(tile).alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("inside", F.coalesce(F.sum(tile).over(inside), F.lit(0))).join(bases, ["file", "block"])
    # the text before a file's first magic is no candidate
    start = F.col("base") + F.col("inside") - len(MAGIC)
    placed = placed.withColumns({"start": start, "stop": start + tile}).drop("base", "inside").filter("start >= 0")
    return placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END))


def _reached(placed: DataFrame) -> DataFrame:
    """``placed`` with ``run``, and of the runs that the chains from the files' starts reach, ``entry``."""
    in_file = Window.partitionBy("file").orderBy("start")
    broken = ~F.col("next").eqNullSafe(F.col("stop"))
    run = F.coalesce(F.sum(broken.cast("long")).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = keep(placed.withColumn("run", run), "warc")
    exits = pieces.filter(~F.col("next").eqNullSafe(F.col("stop")) & F.col("next").isNotNull()).select("file", "run", F.col("next").alias("entry"))
    jumps = keep(exits.join(pieces.select("file", F.col("run").alias("to"), F.col("start").alias("entry")), ["file", "entry"]).select("file", "run", "to", "entry"), "warc")
    reached = pieces.filter("start = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    while jumps.head(1):
        onward = reached.join(jumps.drop("entry").join(jumps.select("file", "run", F.col("entry").alias("e")), ["file", "run"]), ["file", "run"])
        reached = keep(reached.unionByName(onward.select("file", F.col("to").alias("run"), F.col("e").alias("entry"))).distinct(), "warc")
        further = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("last"), F.col("entry").alias("e"))
        jumps = keep(jumps.join(further, ["file", "to"]).select("file", "run", F.col("last").alias("to"), F.col("e").alias("entry")), "warc")
    return pieces.join(reached, ["file", "run"], "left")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """``file, offset, record_type, record_id, target_uri, refers_to, stated_digest,
    stated_length, length, digest`` of each record; ``digest`` is the SHA-1 of the payload
    as read. With ``payload``, the payloads too."""
    marked = _reached(_candidates(spark, path)).withColumn("is_record", F.coalesce(F.col("start") >= F.col("entry"), F.lit(False)))
    so_far = Window.partitionBy("file").orderBy("start")
    marked = marked.withColumn("offset", F.last(F.when(F.col("is_record"), F.col("start")), ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.max("stop").over(Window.partitionBy("file"))
    marked = keep(marked.withColumn("file_end", ends), "warc")
    records = marked.filter("is_record and next <= file_end")
    columns = ["file", "offset", "record_type", "record_id", "target_uri", "refers_to", "stated_digest", "stated_length", "length", "digest"]
    spanning = records.filter("next > stop").select("file", "offset", "head_bytes", "length")
    wanted = records.select("file", "offset", "head_bytes", "length") if payload else spanning
    if not wanted.head(1):
        return records.select(*columns, *([F.lit("").alias("payload")] if payload else []))
    parts = marked.select("file", "block", "piece", "start", "offset").join(wanted, ["file", "offset"])
    parts = keep(parts, "warc")
    few = parts.count() <= BROADCAST_ROWS
    bodies = _pieces(spark, path).join(F.broadcast(parts) if few else parts, ["file", "block", "piece"])
    joined = bodies.groupBy("file", "offset").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "body"))), lambda x: x["body"]), MAGIC).alias("body"))
    text = F.substr("body", F.instr("body", END) + len(END), F.length("body") - F.instr("body", END) - (2 * len(END) - 1))
    whole = joined.select("file", "offset", text.alias("payload")).withColumn("own", F.sha1("payload"))
    # pieces are found again by their splits: a payload that is not whole then is an error, never a result
    lost = F.raise_error(F.concat(F.lit("the archive's splits changed while it was read: "), "file", F.lit(" at "), F.col("offset").cast("string")))
    found = F.octet_length("payload") == F.col("length")
    out = records.join(whole, ["file", "offset"], "left").withColumn("digest", F.when(found, F.col("own")).when(F.col("next") > F.col("stop"), lost).otherwise(F.col("digest")))
    return out.select(*columns, *(["payload"] if payload else []))
