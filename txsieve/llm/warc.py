"""Web archives: WARC records written as text files of Spark, read back by their chain of record boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import cut, table
from txsieve.session import new_run_folder

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of so many bytes or more are written once.
LEAST_SHARED = 1000
RECORDS_PER_FILE = 4000


def records(pages: DataFrame) -> DataFrame:
    """(record): the text of one WARC record a page, without the two line ends that follow it in a file.

    Of pages whose payloads are equal and have ``LEAST_SHARED`` bytes or more, those with the largest page_id are responses and the others
    revisit them without a payload of their own. Null html is an empty payload; null ids come below all others, and a payload that
    only such pages have is a response. Ids are compared as numbers. The largest id of a payload is found by partial maxima, and only payloads
    with copies are joined back; the join is adaptive, so one payload in a third of all pages is split among tasks.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("payload"), F.col("url"))
    page = page.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    largest = (
        page.filter(F.col("bytes") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 AND refers_to IS NOT NULL")
        .select("digest", "refers_to")
    )
    joined = page.join(cut(largest, "warc-payloads"), "digest", "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    name = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", name("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, F.when(again, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Gzipped WARC files of at most ``RECORDS_PER_FILE`` records: each row a record, ended as the format asks."""
    writer = records(pages).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(folder)


def _parse(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(bytes of the header, length of the content, fields) of what follows a magic, or None where no header does."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in piece[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or len(length) > 18 or "warc-type" not in fields:
        return None
    return end + 4, int(length), fields


_PIECES = "file string, block long, place long, size long, head long, content long, fields map<string,string>, sha1 string"


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies between two magics, as a candidate record: its place in the file and, where it starts with a header, its length."""
    key, place = None, 0
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("place", "size", "head", "content", "fields", "sha1")}
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        for file, block, piece in zip(files, blocks, batch.column("value").to_pylist(), strict=True):
            if key != (file, block):
                key, place = (file, block), 0
            found = _parse(piece)
            head, content, fields = found or (None, None, None)
            whole = found and len(piece) >= head + content
            out["place"].append(place)
            out["size"].append(len(piece))
            out["head"].append(head)
            out["content"].append(content)
            out["fields"].append(list(fields.items()) if found else None)
            out["sha1"].append(hashlib.sha1(piece[head : head + content]).hexdigest() if whole else None)
            place += 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"),
                batch.column("block"),
                *(pa.array(out[n], pa.int64()) for n in ("place", "size", "head", "content")),
                pa.array(out["fields"], pa.map_(pa.string(), pa.string())),
                pa.array(out["sha1"], pa.string()),
            ],
            ["file", "block", "place", "size", "head", "content", "fields", "sha1"],
        )


_STARTS = "file string, block long, place long, record long, ends long"


def reachable(following: np.ndarray) -> np.ndarray:
    """Which nodes a chain from node 0 reaches, where ``following`` names each node's successor and its own length means none.

    Pointer jumping: each round marks what marked nodes jump to, then doubles every jump, so that a chain of n records takes log2(n) rounds.
    """
    size = len(following)
    jump = np.append(following, size)
    marked = np.zeros(size + 1, bool)
    marked[:1] = size > 0
    while True:
        before = int(marked[:size].sum())
        marked[jump[np.flatnonzero(marked)]] = True
        if int(marked[:size].sum()) == before:
            return marked[:size]
        jump = jump[jump]


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """The reachable candidates of one file: all its pieces in order give the offsets, and jumps from the file's start the records."""
    pieces = pieces.sort_values(["block", "place"], kind="stable").reset_index(drop=True)
    magic = len(MAGIC)
    # The first piece of a file lies before its first magic.
    at = np.cumsum(pieces["size"].to_numpy(np.int64) + magic) - pieces["size"].to_numpy(np.int64) - magic - magic
    stop = at + magic + pieces["head"].fillna(-1).to_numpy(np.int64) + pieces["content"].fillna(-1).to_numpy(np.int64) + len(GAP)
    size = len(pieces)
    known = pieces["head"].notna().to_numpy()
    after = np.searchsorted(at, stop)
    hit = known & (after < size) & (at[np.minimum(after, size - 1)] == stop)
    ends = int(at[-1] + magic + pieces["size"].iloc[-1]) if size else 0
    last = known & (stop == ends)
    following = np.where(hit, after, size)
    live = np.flatnonzero(at >= 0)
    marked = np.zeros(size, bool)
    if len(live) and at[live[0]] == 0:
        first = live[0]
        marked[first:] = reachable(np.where(following[first:] < size, following[first:] - first, size - first))
    marked &= hit | last
    record = np.cumsum(marked) - 1
    kept = np.flatnonzero(record >= 0)
    out = pieces.loc[kept, ["file", "block", "place"]]
    return out.assign(record=at[np.flatnonzero(marked)][record[kept]], ends=stop[np.flatnonzero(marked)][record[kept]])


def read_archives(spark, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, digest, bytes) of every record of the archives, with true boundaries only.

    Files are dealt to tasks, uncompressed ones split by bytes; tasks cut at every magic and emit each piece's header as a candidate record whose length leads
    to its successor. A file's candidates, a row of numbers each, meet in one group; jumping from the file's start keeps those that real
    records lead to. A payload with the magic in it comes in several pieces: they are read again and put together for that
    record alone. Records that end in the middle of a file, or after a broken one, are not reached.
    """
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    pieces = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    found = cut(pieces.mapInArrow(_piece_rows, _PIECES), "warc-pieces")
    chained = cut(
        found.select("file", "block", "place", "size", "head", "content").groupBy("file").applyInPandas(_chain, _STARTS), "warc-chain"
    )
    place = ["file", "block", "place"]
    parts = found.join(chained, place).groupBy("file", "record").agg(F.count("*").alias("pieces"), F.min(F.struct("block", "place")).alias("first"))
    long = parts.filter("pieces > 1").select("file", "record")
    heads = parts.select("file", F.col("first.block").alias("block"), F.col("first.place").alias("place"), "record")
    record = found.join(heads, place).select("file", "record", "head", "content", "fields", "sha1")
    wanted = chained.join(long, ["file", "record"]).select(*place, "record")
    again = pieces.mapInArrow(_numbered, "file string, block long, place long, value binary").join(wanted, place)
    glued = again.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("values"))
    magic = F.lit(MAGIC).cast("binary")
    # The magics between the pieces belong to the payload.
    whole = F.aggregate(F.slice("values", 2, 1 << 30), F.element_at("values", 1)["value"], lambda acc, x: F.concat(acc, magic, x["value"]))
    glued = glued.select("file", "record", whole.alias("whole"))
    full = record.join(glued, ["file", "record"], "left")
    content = F.expr("substring(whole, CAST(head + 1 AS INT), CAST(content AS INT))")
    number = lambda field: F.regexp_extract(F.col("fields")[field], r"<urn:page:(-?\d+)>", 1).try_cast("long")
    revisit = F.col("fields")["warc-type"] == "revisit"
    stored = F.when(F.col("whole").isNotNull(), F.sha1(content)).otherwise(F.col("sha1"))
    return full.select(
        number("warc-record-id").alias("page_id"),
        F.when(revisit, F.col("fields")["warc-payload-length"].cast("long")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(F.col("fields")["warc-payload-digest"], "^sha1:", "")).otherwise(stored).alias("payload_digest"),
        F.col("fields")["warc-type"].alias("record_type"),
        F.when(revisit, number("warc-refers-to")).alias("refers_to"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces with their places in their blocks, as in the first reading."""
    key, place = None, 0
    for batch in batches:
        places = []
        for now in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if key != now:
                key, place = now, 0
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("block"), pa.array(places, pa.int64()), batch.column("value")], ["file", "block", "place", "value"]
        )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_run_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


OP3_SQL = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), digested AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM page
), largest AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS biggest FROM digested
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN biggest IS NOT NULL AND page_id IS DISTINCT FROM biggest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM biggest THEN biggest END AS refers_to
FROM largest
"""
