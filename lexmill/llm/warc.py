"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record.

Archives are written as bounded binary values, so Spark's own writers and readers move them and
any file system serves; `read_files` reads real .warc.zst files the same way. The reader loads
the dictionary, walks frame headers and block headers to find each frame, decodes one frame per
record, and validates version line, required headers, lengths, trailer and digests.

Defined cases: a null html is an empty payload; a null url has no target; a url that a
header line can't hold is percent-encoded there and read back as it was; rows of
null page_id are responses that none refers to; rows that repeat page_id and payload of a response
are responses too; very long payloads are records of their own archive; an empty table gives no
archive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import pieces
from lexmill.session import stash

DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 8 << 20
DICT_BYTES, DICT_SAMPLES, SAMPLE_BYTES = 16 << 10, 64, 8 << 10
LEVEL, DATE = 3, "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive that is not valid."""


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(uri: str | None) -> int | None:
    if uri is None:
        return None
    m = re.fullmatch(r"<urn:page:(-?\d*)>", uri)
    if not m:
        raise WarcError(f"a record id of another kind: {uri}")
    return int(m[1]) if m[1] else None


#: Tells that the target is percent-encoded.
ENCODED = "X-Target-Encoding"


def target(url: str | None) -> list[str]:
    """Header lines of a URL; one that a header can't hold as it is, is percent-encoded, and says so."""
    if url is None:
        return []
    if url == re.sub(r"[\x00-\x1f\x7f]", "", url).strip():
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {quote(url)}", f"{ENCODED}: percent"]


def url_of(headers: dict[str, str]) -> str | None:
    url = headers.get("WARC-Target-URI")
    return unquote(url) if ENCODED in headers else url


def record(page, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, payload_digest: str | None = None, date: str = DATE) -> bytes:
    """One WARC record of an HTTP response; a revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page)}",
        f"WARC-Date: {date}",
        *target(url),
        f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        *([f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame, then a frame with a checksum per record. The
    dictionary is trained on a bounded, evenly spaced sample; too few records have none."""
    import zstandard as z

    step = max(1, len(records) // DICT_SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:DICT_SAMPLES]]
    try:
        trained = z.train_dictionary(DICT_BYTES, samples, k=256, d=8) if len(samples) >= 8 else None
    except z.ZstdError:
        trained = None
    head = b""
    if trained is not None:
        body = z.ZstdCompressor(level=LEVEL, write_checksum=True).compress(trained.as_bytes())
        head = DICT_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    packer = z.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    return head + b"".join(map(packer.compress, records))


def frame_end(data, at: int) -> int:
    """End of the frame at `at`: its header and the headers of its blocks tell."""
    import zstandard as z

    if bytes(data[at : at + 4]) != ZSTD_MAGIC:
        raise WarcError("no frame where one should start")
    checksum = bool(data[at + 4] & 4)
    at += z.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data) or (head >> 1) & 3 == 3:
            raise WarcError("a frame is cut off or has a reserved block")
        at += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            at += 4 * checksum
            if at > len(data):
                raise WarcError("a frame is cut off")
            return at


def frames(data: bytes):
    """(offset, content) of each record's frame."""
    import zstandard as z

    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICT_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        body = data[8 : 8 + size]
        if len(body) < size:
            raise WarcError("the dictionary is cut off")
        dictionary = z.ZstdCompressionDict(z.ZstdDecompressor().decompress(body) if body[:4] == ZSTD_MAGIC else body)
        at = 8 + size
    unpacker = z.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic >> 4 == 0x184D2A5:  # other skippable frames
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        end = frame_end(view, at)
        try:
            yield at, unpacker.decompress(view[at:end], max_output_size=1 << 31)
        except z.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from e
        at = end


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a frame that holds exactly one valid record."""
    end = content.find(b"\r\n\r\n")
    if end < 0 or not content.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise WarcError("no record header")
    headers = {}
    for line in content[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"a bad header line: {line[:80]}")
        headers[name.strip()] = value.strip()
    if missing := [h for h in REQUIRED if h not in headers]:
        raise WarcError(f"headers are missing: {missing}")
    if not headers["Content-Length"].isdigit():
        raise WarcError("a bad Content-Length")
    size = int(headers["Content-Length"])
    block = content[end + 4 : end + 4 + size]
    if len(content) != end + 8 + size or content[end + 4 + size :] != b"\r\n\r\n":
        raise WarcError("the record's length is not its Content-Length")
    if (want := headers.get("WARC-Block-Digest", "")).startswith("sha1:") and want[5:] != digest(block):
        raise WarcError("the block's digest is wrong")
    return headers, block


def describe(content: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of a record."""
    headers, block = parse(content)
    kind = headers["WARC-Type"]
    head, blank, payload = block.partition(b"\r\n\r\n")
    if kind not in ("response", "revisit") or not blank:
        raise WarcError(f"a record of another kind: {kind}")
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
    size = int(m[1]) if m else len(payload)
    stated = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response":
        if size != len(payload) or stated != digest(payload):
            raise WarcError("the payload's length or digest is wrong")
        return _page(headers["WARC-Record-ID"]), size, stated, kind, None, url_of(headers), payload
    if payload or not re.fullmatch("[A-Z2-7]{32}", stated) or "WARC-Refers-To" not in headers:
        raise WarcError("a bad revisit")
    return _page(headers["WARC-Record-ID"]), size, stated, kind, _page(headers["WARC-Refers-To"]), url_of(headers), None


def _sha1():
    return F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit(""))))


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, d, refers_to) of pages whose payload, with SHA-1 d, of at least `least` bytes, a smaller page_id
    has too. Only digests move; a payload that a third of all pages share is one small row a task
    in the aggregation, and the join back is of small rows that Spark may split."""
    html = F.coalesce(F.col("html"), F.lit(""))
    small = pages.select("page_id", _sha1().alias("d")).where(F.col("page_id").isNotNull() & (F.octet_length(html) >= least))
    first = small.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return small.join(first, "d").where("page_id <> refers_to").select("page_id", "d", "refers_to").distinct()


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives (records long, content binary) of one record a row of pages(page_id, url, html)."""
    least_rows = stash(revisits(pages, least), "revisits")
    joined = pages.select("page_id", "url", "html", _sha1().alias("d")).join(least_rows.withColumn("revisit", F.lit(True)), ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to", "revisit")

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches, "html"):
            for page, url, html, to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page, url, (html or "").encode(), to, bool(revisit)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([compress(held)], pa.binary())], ["records", "content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([compress(held)], pa.binary())], ["records", "content"])

    return joined.mapInArrow(run, "records long, content binary")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, frame_offset long, payload binary"


def read(archives: DataFrame, content: str = "content", payload: bool = True) -> DataFrame:
    """One row per record of each archive; without payload, that column is left out."""
    names = [c.split()[0] for c in READ.split(", ")][: None if payload else -1]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for at, raw in frames(data.as_py()):
                    *facts, body = describe(raw)
                    rows.append((*facts, at, body) if payload else (*facts, at))
                    size += len(raw) if payload else 256
                    if size > ARCHIVE_BYTES:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return archives.select(content).mapInArrow(run, READ if payload else READ.removesuffix(", payload binary"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)


def read_files(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of .warc.zst files under path, through any file system that Spark reads."""
    return read(spark.read.format("binaryFile").load(path), payload=payload)


def op1(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read(stash(write(pages), "warc", compression="none"), payload=False).drop("frame_offset")


#: Base 32 of a digest by its hexadecimal digits: five bits at a time lie in two digits.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h || '0', i * 5 // 4 + 1, 2))::INT >> (3 - i * 5 % 4)) & 31) + 1, 1)), '')"
ORACLE = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, url FROM p JOIN f USING (h)"""
