"""WARC archives: writing with revisit records, and reading back by boundary-chain verification.

Writing is one pass of Spark's text sink, whose separator is the end of a WARC record, so each file is the plain
concatenation of its records. Reading cuts the files into byte ranges. A task looks for the magic in its range and emits
each candidate with the offset at which its record says the next one starts. Payloads may hold the magic, even a whole
record, so candidates prove nothing: pointer jumping from offset 0 of each file marks the candidates that the chain
reaches, and only those are records.

Of records with equal payloads of at least min_payload bytes, that with the largest id is a response and the others are
revisits of it. Defined cases: null html is an empty payload; a null url is an empty one, one of any length is
kept, and control characters in it are dropped; a null id never wins, and where all ids of a group are null all are responses; repeated rows give repeated
records; an empty table gives no record and an empty result; other columns
are ignored; a file that is cut off or altered between records is an error.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, scratch

END = "\r\n\r\n"
MAGIC = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Dealt to all executors only up to so many groups of copies (about 60 bytes each); beyond it, Spark joins by shuffling.
BROADCAST_GROUPS = 100_000
_HEAD = 1 << 16  # bytes read at first for a record's header; longer headers are read on

CANDIDATE = "path string, split long, offset long, next long, exit long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
_FIELDS = ("path", "split", "offset", "next", "exit", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")


def base32(hex_col):
    """Upper-case base32 of a column of 40 hex digits: four runs of 40 bits, eight digits each."""
    parts = [F.lpad(F.conv(F.substring(hex_col, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> None:
    """Write a record for each row into text files under path."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]+", "")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    copies = rows.where(F.col("size") >= min_payload).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 AND winner IS NOT NULL").select(F.col("sha").alias("of"), "winner", "n")
    copies = materialize(copies, "copies")
    if copies.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(copies.drop("n")), F.col("sha") == F.col("of"), "left")
    else:  # at most 1,000 payloads can be in a thousandth of the rows each: those go to all tasks, so none gets a hot one
        hot = F.col("n") > max(100, pages.count() // 1000)
        tagged = rows.join(F.broadcast(copies.where(hot).drop("n")), F.col("sha") == F.col("of"), "left")
        rest = tagged.where(F.col("of").isNull()).drop("of", "winner").join(copies.where(~hot).drop("n"), F.col("sha") == F.col("of"), "left")
        rows = tagged.where(F.col("of").isNotNull()).unionByName(rest)
    again = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("winner").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


class _Range:
    """A file of which bytes are read as they are asked for."""

    def __init__(self, uri: str, start: int, end: int):
        from pyarrow import fs

        if uri.startswith("file:/"):
            files, name = fs.LocalFileSystem(), unquote(uri[5:]).replace("///", "/")
        else:
            files, name = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(name)
        self.start, self.data = start, self._at(start, min(end + _HEAD, self.file.size()) - start)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def get(self, offset: int, n: int) -> bytes:
        i = offset - self.start
        return self.data[i : i + n] if i + n <= len(self.data) else self._at(offset, n)

    def sha1(self, offset: int, n: int, step: int = 1 << 22) -> str:
        h = hashlib.sha1()
        for i in range(0, n, step):
            h.update(self.get(offset + i, min(step, n - i)))
        return base64.b32encode(h.digest()).decode()


def _number(text: str) -> int | None:
    return int(text) if text.lstrip("-").isdigit() else None


def _header(file: _Range, offset: int, size: int) -> bytes | None:
    """The bytes at offset up to the first blank line, read on until it is found. None where a whole line before it has no
    colon, as those of payloads soon do, or where the file ends first."""
    n, whole = _HEAD, len(MAGIC)
    while True:
        head = file.get(offset, min(n, size - offset))
        stop = head.find(b"\r\n\r\n")
        if stop >= 0:
            return head[:stop]
        last = head.rfind(b"\r\n", whole)
        if n >= size - offset or (last > whole and any(b":" not in line for line in head[whole:last].split(b"\r\n"))):
            return None
        n *= 2


def _record(file: _Range, offset: int, size: int) -> dict | None:
    """What the bytes at offset say, if they are the header of a record that ends within the file."""
    head = _header(file, offset, size)
    if head is None:
        return None
    stop, fields = len(head), {}
    for line in head[len(MAGIC) :].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length, body = _number(fields.get("content-length", "")), offset + stop + 4
    if length is None or length < 0 or body + length + 4 > size or file.get(body + length, 4) != b"\r\n\r\n":
        return None
    page = lambda f: _number(fields.get(f, "").removeprefix("<urn:page:").removesuffix(">"))
    out = {"offset": offset, "next": body + length + 4, "record_type": fields.get("warc-type"), "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to")}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": _number(fields.get("x-payload-length", "")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    skip = file.get(body, min(_HEAD, length)).find(b"\r\n\r\n") + 4
    return out | {"payload_bytes": length - skip, "payload_digest": file.sha1(body + skip, length - skip)}


def _scan(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "record_type": pa.string(), "payload_digest": pa.string()}
    schema = pa.schema([(f, kinds.get(f, pa.int64())) for f in _FIELDS])
    for batch in batches:
        for row in batch.to_pylist():
            start = row["split"] * step
            end = min(start + step, row["length"])
            file = _Range(row["path"], start, end)
            found, at = [], file.data.find(MAGIC)
            while 0 <= at < end - start:
                if record := _record(file, start + at, row["length"]):
                    found.append(record)
                at = file.data.find(MAGIC, at + 1)
            exits: dict[int, int] = {}  # where the chain from a candidate leaves this range; -1 if it breaks off
            for r in reversed(found):
                exits[r["offset"]] = r["next"] if r["next"] >= end else exits.get(r["next"], -1)
            yield pa.RecordBatch.from_pylist([r | {"path": row["path"], "split": row["split"], "exit": exits[r["offset"]]} for r in found], schema=schema)


def _walk(key: tuple, table: pa.Table) -> pa.Table:
    """The records on the chain of one range, from the entry that the pointer jumping found."""
    rows = {r["offset"]: i for i, r in enumerate(table.select(["offset"]).to_pylist())}
    nexts, at, keep = table["next"].to_pylist(), table["entry"][0].as_py(), []
    while at in rows:
        keep.append(rows[at])
        at = nexts[rows[at]]
    return table.drop_columns(["entry"]).take(pa.array(keep, pa.int64()))


def read_warc(spark: SparkSession, path: str, split_bytes: int = 4 << 20, strict: bool = True) -> DataFrame:
    """One row per record of the archives under path, with its file, offset, ids, type, and its payload's size and digest.

    A file whose chain of records does not end where the file does is damaged. strict: that is an error; otherwise the
    records up to the damage are returned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").where("length > 0")
    ranges = files.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {split_bytes}"))))
    longest = ranges.agg(F.max("split")).first()[0]
    ranges = ranges.repartition("path", "split")
    found = materialize(ranges.mapInArrow(lambda batches: _scan(batches, split_bytes), CANDIDATE), "candidates")
    # nodes: candidates at which the chain can enter a range; each points to where it leaves it
    entries = found.select("path", F.col("exit").alias("offset")).where("offset >= 0").unionByName(found.select("path", F.lit(0).cast("long").alias("offset"))).distinct()
    jump = materialize(entries.join(found.select("path", "split", "offset", "exit"), ["path", "offset"]), "jumps")
    reached = jump.where("offset = 0").select("path", "offset")
    hop = jump.select("path", "offset", "exit")
    for _ in range(math.ceil(math.log2((longest or 0) + 2))):
        further = reached.join(hop, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        before, reached = reached, materialize(reached.unionByName(further).distinct(), "reached")
        ahead = hop.select("path", F.col("offset").alias("exit"), F.col("exit").alias("beyond"))
        last, hop = hop, materialize(hop.join(ahead, ["path", "exit"]).select("path", "offset", F.col("beyond").alias("exit")), "hops")
        discard(before, last)
    if strict:
        broken = files.join(reached.select("path", F.col("offset").alias("length")), ["path", "length"], "left_anti").limit(5).collect()
        if broken:
            raise ValueError(f"records do not reach the end of {[r['path'] for r in broken]}")
    entry = reached.join(jump, ["path", "offset"]).groupBy("path", "split").agg(F.min("offset").alias("entry"))
    return found.join(entry, ["path", "split"]).select(*_FIELDS, "entry").groupBy("path", "split").applyInArrow(_walk, CANDIDATE)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Write the pages as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col, min_payload)
    return read_warc(spark, path)
