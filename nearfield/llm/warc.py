"""WARC archives: a writer and a sequential reader, one gzip member per record.

Files are written and read through ``pyarrow.fs`` by URI, so the folder may be in any store that it reaches. A writer's task
writes to a name of its own attempt and renames it when complete; a task that is repeated replaces the file by an equal one.
The reader inflates a member piece by piece and never holds more than one record's payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.storage import materialise, shared_path

PIECE = 1 << 18
OUT = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_id(page_id, digest: str, again: str = "") -> str:
    """The id of a page's record; ``again`` sets further rows with the same page_id and payload apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}{again}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, size: int, again: str = "") -> bytes:
    """One record before compression; a revisit carries no block, only the size and digest of the payload it stands for."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest, again)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        head.append(f"X-Refers-To-Page: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a byte stream, its inflated pieces. Each inner iterator must be used up before the next."""
    pending = stream.read(PIECE)
    while pending:
        state = [zlib.decompressobj(31), pending]

        def pieces(state=state):
            z, data = state
            while True:
                got = z.decompress(data, PIECE)
                if got:
                    yield got
                if z.eof:
                    state[1] = z.unused_data
                    return
                data = z.unconsumed_tail or stream.read(PIECE)
                if not data and not got:
                    raise ValueError("archive ends inside a gzip member")

        inner = pieces()
        yield inner
        for _ in inner:
            pass
        pending = state[1] or stream.read(PIECE)


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of a member; framing follows Content-Length and is verified."""
    head = bytearray()
    while (cut := head.find(b"\r\n\r\n")) < 0:
        try:
            head += next(pieces)
        except StopIteration:
            raise ValueError("record ends inside its header") from None
    lines = head[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC version line")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    rest = bytearray(head[cut + 4 :])
    for piece in pieces:
        rest += piece
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    return fields, bytes(rest[:n])


def with_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with payload, its size and digest, and the page it refers to.

    Of records with equal payloads of at least ``least`` bytes, that with the largest page_id is the response and the others
    revisit it; rows that repeat this page_id are responses too. A null page_id refers to the response, if there is one with an id.
    The digest's hot values meet only in a partial maximum and in a join that Spark can split.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", payload.alias("payload"))
    base = base.withColumn("size", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    each = base.groupBy("sha1", "size", "page_id").agg(F.count("*").alias("rows"))
    top = each.groupBy("sha1", "size").agg(F.max(F.when(F.col("size") >= least, F.col("page_id"))).alias("top"), F.max("rows").alias("most"))
    refers = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    alone = F.col("page_id").isNotNull() & (F.col("most") == 1)
    return base.join(top, ["sha1", "size"], "left").withColumn("refers_to", refers).withColumn("alone", alone)


def write_archives(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per page below ``folder``; returns (path, records) of the archives, on evaluation of which they are written.

    Null html is an empty payload; null url leaves the header out; columns other than page_id, url and html are ignored;
    an empty table writes no archive.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        part, k, out, path, n, size = TaskContext.get().partitionId(), 0, None, "", 0, 0
        attempt = TaskContext.get().taskAttemptId()

        def close():
            out.close()
            final = f"{root}/part-{part:06d}-{k:04d}.warc.gz"
            fs.move(path, final)
            return pa.RecordBatch.from_pydict({"path": [final], "records": pa.array([n], pa.int64())})

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for page_id, url, payload, size_of, sha, refers, alone in zip(*(c.to_pylist() for c in cols), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/_attempt-{attempt}-{k:04d}"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                # a page's record is named by its page_id and digest; null page_ids, and ids that several rows have, by their place too
                data = gzip_member(record(page_id, url, payload, digest, refers, size_of, "" if alone else f"/{part}/{k}/{n}"))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    rows = with_records(pages, least).select("page_id", "url", "payload", "size", "sha1", "refers_to", "alone")
    return rows.mapInArrow(write, "path string, records long")


def read_archives(paths: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives named in ``paths.path``, each file read once from start to end.

    digest_ok: the block's digest equals the header's; null for a revisit, which has no block (see ``verified``). Damaged members
    and wrong lengths raise ValueError.
    """

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for pieces in members(stream):
                        f, block = read_record(pieces)
                        number = lambda k, f=f: int(f[k]) if k in f else None
                        told = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = f["WARC-Type"] == "response"
                        size = len(block) if response else number("X-Payload-Length")
                        digest = sha1_base32(block) if response else told
                        rows.append((number("X-Page-Id"), f.get("WARC-Target-URI"), f["WARC-Type"], number("X-Refers-To-Page"), size, digest, digest == told if response else None, block if payloads else None))
                        held += len(block)
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return paths.select("path").mapInArrow(read, OUT)


def verified(records: DataFrame) -> DataFrame:
    """records with digest_ok of revisits: whether the response that they refer to was read, sound and with their digest and length.

    A response that a third of all records refer to is one row on its side of a join that Spark can split.
    """
    rest = [c for c in records.columns if c != "digest_ok"]
    sound = records.where("record_type = 'response' AND digest_ok AND page_id IS NOT NULL")
    sound = sound.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("sound_")).distinct()
    both = records.join(sound, ["refers_to", "payload_digest", "payload_bytes"], "left")
    return both.select(*rest, F.when(F.col("record_type") == "revisit", F.coalesce("sound_", F.lit(False))).otherwise(F.col("digest_ok")).alias("digest_ok"))


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the archives, then read them back."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    written = write_archives(pages, folder, least)
    index = f"{folder}-index"
    written.write.parquet(index)
    paths = spark.read.parquet(index)
    read = read_archives(paths.repartition(max(1, min(paths.count(), 10_000)), "path"), folder, payloads=False)
    return verified(materialise(read.drop("payload"), "warc-records"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9_warc: one row per page as read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = round_trip(pages)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


#: The same rows by SQL; 20 bits, five hexadecimal digits, make four letters of base 32.
ORACLE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
t AS (SELECT d, max(page_id) AS top FROM p GROUP BY d)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(p.d, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS digest_ok
FROM p JOIN t USING (d)"""
