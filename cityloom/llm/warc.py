"""WARC archives of pages, and the normaliser of monolithic gzip archives.

Spark's text writer lays records out as WARC files compressed as one gzip stream each. The normaliser inflates such a stream
once, from front to end in pieces, writes every record again as a gzip member of its own and puts an index of offsets beside
it. Records are then read by offset from the normalised archives.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.common import delete_path, drop_table, new_path, partitions, write_table

LINE = "\r\n"
#: Payloads of fewer bytes are never turned into revisit records.
LEAST_REVISIT = 1000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri if ":/" in uri else f"file://{uri}")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``id, record``: a WARC record (without its closing blank lines) for each row.

    Of rows with equal payloads of at least ``least`` bytes that with the largest id is a response, the others are revisits of
    it. A null payload is empty, a null id is written as such and is smaller than any other; line breaks in a url are left out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sha, size = F.sha1(F.encode("html", "utf-8")), F.octet_length("html")
    light = write_table(rows.select("id", sha.alias("sha"), size.alias("size")).where(F.col("size") >= least), "digests")
    best = light.groupBy("sha", "size").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1 AND best IS NOT NULL")
    again = light.join(best, ["sha", "size"]).where(~F.col("id").eqNullSafe(F.col("best"))).select(F.col("id").alias("i"), F.col("sha").alias("s"), "best").distinct()
    rows = rows.withColumn("sha", sha).withColumn("size", size).join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left")
    revisit = F.col("best").isNotNull()
    http = F.concat_ws(LINE, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("size")), F.lit(""), F.lit(""))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    fields: list[Column] = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("best"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return rows.select("id", F.concat(F.concat_ws(LINE, *fields), F.lit(LINE + LINE), block).alias("record"))


def write_monolithic(records: DataFrame, path: str) -> None:
    """Write records as WARC files, each one gzip stream: one for each partition that the records come in."""
    records.select("record").write.text(path, compression="gzip", lineSep=LINE + LINE)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by name in lower case, with or without a blank after the colon; of repeated ones the last."""
    pairs = (line.decode("utf-8", "replace").partition(":") for line in head.split(b"\r\n") if b":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _length(head: bytes) -> int:
    stated = _fields(head).get("content-length", "")
    if not stated.isdecimal():
        raise ValueError(f"record without a length: {head[:80]!r}")
    return int(stated)


def split_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a gzip stream, or of several on end, inflated once in pieces.

    A stream that ends before its gzip trailer, or within a record, is an error: the records that it lost can't be told from none.
    No bytes at all are no records.
    """
    inflate, held, open_stream = zlib.decompressobj(31), bytearray(), False
    for chunk in chunks:
        while chunk:
            open_stream = True
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate, open_stream = zlib.decompressobj(31), False
            begin = 0
            while (head := held.find(b"\r\n\r\n", begin)) >= 0:
                end = head + 4 + _length(bytes(held[begin:head])) + 4
                if end > len(held):
                    break
                yield bytes(held[begin:end])
                begin = end
            del held[:begin]
    if open_stream:
        raise ValueError("archive ends within its gzip stream")
    if held:
        raise ValueError("archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block)."""
    head, _, block = record.partition(b"\r\n\r\n")
    return _fields(head), block[: _length(head)]


def _members(source: str, name: str, piece: int = 1 << 20) -> int:
    """Normalise one archive; both files appear under their names only when whole, so that a repeated task does no harm."""
    fs, path = _open(source)
    target, to = _open(name)
    mark, n, at = uuid.uuid4().hex, 0, 0
    with fs.open_input_stream(path, compression=None) as stream, target.open_output_stream(f"{to}.{mark}", compression=None) as out, target.open_output_stream(f"{to}.idx.{mark}", compression=None) as index:
        for record in split_stream(iter(lambda: stream.read(piece), b"")):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = pack.compress(record) + pack.flush()
            out.write(member)
            headers, _ = parse(record)
            line = {"archive": name, "number": n, "offset": at, "length": len(member), "record_id": headers.get("warc-record-id"), "type": headers.get("warc-type")}
            index.write(json.dumps(line).encode() + b"\n")
            at, n = at + len(member), n + 1
    for suffix in (".idx", ""):
        target.move(f"{to}{suffix}.{mark}", f"{to}{suffix}")
    return n


def normalise(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Normalise all archives under path into the shared folder target; returns ``archive, records, error`` (one task an archive).

    A damaged archive (cut short, not gzip, a record without a length) has its error and no records; nothing of it is written under
    its name, and the others are not held up by it.
    """
    _open(target)[0].create_dir(_open(target)[1], recursive=True)
    files = spark.read.format("binaryFile").load(path).select("path")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["path"]:
                name = f"{target}/{source.rsplit('/', 1)[-1].split('.')[0]}.warc.gz"
                try:
                    n, error = _members(source, name), None
                except (ValueError, zlib.error) as damage:
                    n, error = 0, f"{source}: {damage}"
                yield pd.DataFrame({"archive": [name], "records": [n], "error": pd.Series([error], dtype=object)})

    return files.repartition(partitions(spark), "path").mapInPandas(work, "archive string, records long, error string")


def index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar indexes of all archives in target."""
    return spark.read.schema("archive string, number long, offset long, length long, record_id string, type string").json(f"{target}/*.idx")


def read_records(entries: DataFrame) -> DataFrame:
    """Read the records of index entries by offset: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload``.

    payload is null for revisits, whose digest and length are those that their headers state. Those of responses are taken from the
    payload as read; where they differ from what the headers state, the record is damaged: an error.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").rstrip(">")
        return int(digits) if digits else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for archive, part in batch.groupby("archive"):
                fs, path = _open(archive)
                with fs.open_input_file(path) as f:
                    for offset, length in zip(part["offset"], part["length"]):
                        f.seek(offset)
                        headers, block = parse(zlib.decompress(f.read(length), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = _length(http)
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            stated, (digest, size) = (digest, size), (hashlib.sha1(payload).hexdigest(), len(payload))
                            if stated != (digest, size):
                                raise ValueError(f"{archive} at {offset}: payload of {size} bytes, sha1 {digest}; stated {stated}")
                        out.append((number(headers["warc-record-id"]), headers.get("warc-target-uri", ""), kind, number(headers.get("warc-refers-to")), digest, size, payload.decode("utf-8") if kind == "response" else None))
            rows = pd.DataFrame(out, columns=schema.replace(",", "").split()[::2])
            yield rows.astype({"page_id": "Int64", "refers_to": "Int64"})

    keyed = entries.select("archive", "offset", "length", F.floor(F.col("number") / 16).alias("run"))
    return keyed.repartition(partitions(entries.sparkSession), "archive", "run").sortWithinPartitions("archive", "offset").drop("run").mapInPandas(work, schema)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as monolithic archives, normalise those, and read every record back through the index.

    An empty table gives an empty result; columns other than the three named are not read. Damaged archives are an error that
    names them.
    """
    spark = pages.sparkSession
    raw, target = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write_monolithic(records(pages, id_col, url_col, html_col), raw)
    done = write_table(normalise(spark, raw, target), "normalised")
    damaged = [r["error"] for r in done.where("error IS NOT NULL").orderBy("archive").limit(20).collect()]
    if damaged:
        raise ValueError("damaged archives: " + "; ".join(damaged))
    drop_table(done)
    delete_path(spark, raw)
    return read_records(index(spark, target))
