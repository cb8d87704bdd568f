"""WARC archives: a writer, and a reader that salvages damaged ones.

The writer makes one record per page.  A payload that occurred with a smaller
page_id is not written again: its record is a ``revisit`` that refers to the
page with the smallest one, as ``LEAST_PAYLOAD`` allows.  Every record has the
digest of its payload and of its block, and every block an HTTP head with the
payload's full length.  Archives are closed at ``ARCHIVE_BYTES`` (a larger
record has its own); compressed ones are gzip members, one per record, and
nothing else.  They are written by Spark's text writer, a row per archive: its
line separator is the last record's end, or the zero byte that a member ends
with.  So any store that Spark reaches will do, and a task that is run again
replaces what it wrote.

Only ids, urls and digests are joined to find revisits.  Payloads whose digest
has no bit in the bit array of repeated digests stay where they are; of the
others only those to be written are shuffled, by page and digest, so copies of
one payload don't meet in one task.

The reader checks version line, length, record end and, where there are such
of a known kind, block and payload digests.  After a failed check it looks for
the next gzip magic or version line from which a whole valid record can be
read, goes on there, and logs the bytes in between as a quarantined gap.  White
space between records is no gap.  A gzip member may hold any number of records;
what is bad in one is a gap with the member's bytes.  It reads members in small
pieces, so its time grows with the archive, not with its square.

Null html is an empty payload; a null url gives a record without target, line
breaks in urls are escaped.  Rows with a null page_id are responses with id
``null`` unless their payload belongs to a page with an id.  Rows that share
the smallest page_id of a payload are all responses.  An empty table gives no
archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.llm.common import bit_array, map_arrow, materialize, may_be_in, shared_dir, table

#: Smaller payloads are always written in full.
LEAST_PAYLOAD = 0
#: An archive ends with the record that brings it to so many bytes (before compression of the next).
ARCHIVE_BYTES = 16 << 20
#: A head is looked for in so many bytes.
HEAD_BYTES = 1 << 20
END = b"\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GZIP = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_BLANK = re.compile(rb"[\r\n]*")


def base32(digest: str) -> str:
    """SQL text: bare upper-case base32 of a hex digest whose length divides by five characters."""
    letters = ", ".join(f"substr('{_ALPHABET}', cast(shiftright(v, {s}) & 31 as int) + 1, 1)" for s in (15, 10, 5, 0))
    part = f"transform(array(conv(substr({digest}, g * 5 + 1, 5), 16, 10)), c -> transform(array(cast(c as bigint)), v -> concat({letters}))[0])[0]"
    return f"array_join(transform(sequence(0, 7), g -> {part}), '')"


def records(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (empty for revisits), ``bytes``, ``digest`` and ``refers_to`` (null: response) of every page."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("payload"))
    own = own.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1(F.col("payload").cast("binary")).alias("digest"))
    # of payloads found twice or more the first page
    thin = materialize(own.drop("payload"))
    first = thin.where(F.col("bytes") >= least_payload).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("least"))
    first = materialize(first.where("n > 1").select("digest", "bytes", "least"))
    again = (F.col("bytes") >= least_payload) & may_be_in(bit_array(first, "digest"), "digest")
    known = thin.where(again).join(first, ["digest", "bytes"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")))
    responses = known.where("refers_to is null").select(F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct()
    own = own.withColumn("refers_to", F.lit(None).cast("long"))
    whole = own.where(~again).unionByName(own.where(again).join(responses, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left_semi"))
    every = whole.unionByName(known.where("refers_to is not null").select("page_id", "url", F.lit("").alias("payload"), "bytes", "digest", "refers_to"))
    return every.withColumn("digest", F.expr(base32("digest")))


def record_text(date: str = "2024-01-01T00:00:00Z") -> str:
    """SQL text: the whole record, without its end, of a row of ``records``."""
    name = "concat('<urn:page:', coalesce(cast({} as string), 'null'), '>')"
    target = "if(url is null, '', concat('WARC-Target-URI: ', regexp_replace(url, '[\\\\x00-\\\\x20\\\\x7f]', '%20'), '\\r\\n'))"
    kind = f"if(refers_to is null, 'WARC-Type: response\\r\\n', concat('WARC-Type: revisit\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\\r\\nWARC-Refers-To: ', {name.format('refers_to')}, '\\r\\n'))"
    block = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', bytes, '\\r\\n\\r\\n', if(refers_to is null, payload, ''))"
    head = f"concat('WARC/1.1\\r\\n', {kind}, 'WARC-Record-ID: ', {name.format('page_id')}, '\\r\\n', 'WARC-Date: {date}\\r\\n', {target}, 'WARC-Payload-Digest: sha1:', digest, '\\r\\n', 'WARC-Block-Digest: sha1:', {base32('bd')}, '\\r\\n', 'Content-Type: application/http; msgtype=response\\r\\n', 'Content-Length: ', octet_length(block), '\\r\\n\\r\\n', block)"
    return f"transform(array({block}), block -> transform(array(sha1(cast(block as binary))), bd -> {head})[0])[0]"


def write_archives(pages: DataFrame, path: str, compress: bool = False, archive_bytes: int = ARCHIVE_BYTES, suffix: str | None = None) -> None:
    """Write archives of all ``pages`` under ``path``.

    They have the names of Spark's writer, ``part-…``; ``suffix`` (like
    ``.warc.gz``) renames them, file by file, which stores without a rename
    pay for with a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            if not compress:
                return pa.RecordBatch.from_arrays([pa.array([END.join(parts)], pa.binary())], ["archive"])
            # the zero byte that ends a member is the line separator; one of 16 MB or more may end otherwise
            whole = b"".join(parts if parts[-1][-1] == 0 else [*parts, member(b"")])
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], ["archive"])

        for x in batches:
            for r in x.column("record"):
                raw = r.as_buffer().to_pybytes()
                parts.append(member(raw + END) if compress else raw)
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    parts, size = [], 0
        if parts:
            yield archive()

    texts = records(pages).select(F.expr(record_text()).alias("record"))
    blobs = map_arrow(texts, run, "archive binary").select(F.col("archive").cast("string"))
    blobs.write.option("lineSep", "\0" if compress else END.decode()).option("maxRecordsPerFile", 1).text(path)
    if suffix:
        _rename(pages.sparkSession, path, suffix)


def _rename(spark: SparkSession, path: str, suffix: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-") and not fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + suffix)):
            raise OSError(f"cannot rename {name}")


def member(data: bytes) -> bytes:
    """One gzip member; the same bytes each time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


_HASHES = {"sha1": 20, "sha256": 32, "sha512": 64, "md5": 16}


def _holds(said: str | None, data: bytes) -> bool:
    """Whether ``data`` has the digest that is said (``sha1:…``, in base32 or hex); true where none of a known kind is."""
    kind, _, value = (said or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in _HASHES or not value.strip():
        return True
    found = hashlib.new(kind, data).digest()
    value = value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the plain record at ``at``, if it is whole and valid."""
    if not (start := _START.match(data, at)) or (stop := data.find(END, start.end() - 2, start.end() + HEAD_BYTES)) < 0:
        return None
    headers = {}
    for line in data[start.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        key = name.strip().lower().decode("latin-1")
        if not colon or key in headers and key != "warc-concurrent-to":  # the head of another record has been run into
            return None
        headers[key] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None
    body = stop + len(END)
    end = body + int(length)
    if data[end : end + len(END)] != END:
        return None
    block = data[body:end]
    return (headers, block, end + len(END)) if _holds(headers.get("warc-block-digest"), block) else None


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``, if it is whole and its check sum holds."""
    z, out, piece = zlib.decompressobj(31), [], 1 << 10
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(data[at : at + piece]))
            at, piece = min(len(data), at + piece), min(1 << 18, piece * 2)
    except zlib.error:
        return None
    return (b"".join(out), at - len(z.unused_data)) if z.eof else None


Found = tuple[str, int, int, dict[str, str], bytes]


def salvage(data: bytes) -> Iterator[Found]:
    """``("record", start, end, headers, block)`` and ``("gap", start, end, {}, b"")`` in order."""
    at = gap = 0
    while at < len(data):
        found: list[Found] = []
        end = at
        if data.startswith(_GZIP, at):
            if inner := _member(data, at):
                end = inner[1]
                parts = list(salvage(inner[0]))
                if any(k == "record" for k, *_ in parts) or _BLANK.fullmatch(inner[0]):
                    found = [("record", at, end, h, b) for k, _, _, h, b in parts if k == "record"]
                    found += [("gap", at, end, {}, b"")] * any(k == "gap" for k, *_ in parts)
                else:
                    end = at
        elif own := _record(data, at):
            end = own[2]
            found = [("record", at, end, own[0], own[1])]
        if end > at:
            if not _BLANK.fullmatch(data, gap, at):
                yield "gap", gap, at, {}, b""
            yield from found
            at = gap = end
        else:
            later = _NEXT.search(data, at + 1)
            at = later.start() if later else len(data)
    if not _BLANK.fullmatch(data, gap, len(data)):
        yield "gap", gap, len(data), {}, b""


_COLUMNS = "path string, kind string, start long, stop long, page_id long, record_type string, refers_to long, uri string, payload_bytes long, payload_digest string, payload binary"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _row(path: str, found: Found) -> tuple:
    kind, start, stop, headers, block = found
    if kind == "record":
        what = headers.get("warc-type")
        http = headers.get("content-type", "").startswith("application/http")
        head, _, payload = block.partition(END) if http else (b"", b"", block)
        said = headers.get("warc-payload-digest")
        if what == "revisit" or _holds(said, payload):
            length = re.search(rb"(?im)^content-length: *(\d+)", head) if what == "revisit" else None
            digest = said.removeprefix("sha1:") if said else None if what == "revisit" else _sha1(payload)
            return path, kind, start, stop, _page(headers.get("warc-record-id")), what, _page(headers.get("warc-refers-to")), headers.get("warc-target-uri"), int(length[1]) if length else len(payload), digest, payload
    return path, "gap", start, stop, *[None] * 7


def read_archives(spark: SparkSession, path: str, names: str = "part-*") -> DataFrame:
    """A row per record or gap: ``path``, ``kind``, ``start``, ``stop``, ``page_id``, ``record_type``, ``refers_to``, ``uri``, ``payload_bytes``, ``payload_digest``, ``payload``.

    An archive is read by one task (the writer bounds archives), its rows go on
    in small batches.  A record without the payload digest that it claims is a
    gap; one that claims none gets its payload's SHA-1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in _COLUMNS.split(", ")]

        def out(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})

        for x in batches:
            for path, data in zip(x["path"], x["content"], strict=True):
                rows: list[tuple] = []
                size = 0
                for found in salvage(data):
                    rows.append(_row(path, found))
                    size += 200 + len(found[4])
                    if size > 1 << 22:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content")
    return files.mapInPandas(run, _COLUMNS)


def gap_log(found: DataFrame) -> DataFrame:
    """The quarantined bytes of what ``read_archives`` found: ``path``, ``start``, ``stop``."""
    return found.where("kind = 'gap'").select("path", "start", "stop")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path, compress=True)
    found = read_archives(spark, path).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, cast(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS least FROM p),
e AS (SELECT *, list_transform(range(0, 8), lambda g: cast('0x' || substr(hex, g * 5 + 1, 5) AS INTEGER)) AS parts FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((parts[cast(i // 4 + 1 AS BIGINT)] >> cast(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM least THEN NULL ELSE least END AS refers_to
FROM e
"""
