"""Deterministic sharded WARC archives of pages, and their reader.

Pages are dealt to shards by ranges of their id, which come from a histogram of
payload bytes refined until its bins are small; a bin of one id, or of rows
without one, that is still larger than a shard is split by digest. Each record
is one gzip member, compressed before the exchange, so a shard's writer only
sorts, appends and rolls to the next file by compressed size. The same pages
give the same files, byte for byte, whatever the cluster.

A write has a folder, a generation, of its own, and a task writes there under a
temporary name of its own attempt. The rows that the job returns, and so only
those of attempts that count, make the generation's manifest, and the files that
it names are moved into place. One small file that names the generation is the
commit: it appears whole under the next free number or not at all, so readers
see the last whole archive whatever happens to a later write. They open nothing
that its manifest does not name, and compare size, records and hash with it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefly.llm.common import Scratch, remove, slices
from stonefly.sources.publish import names, publish, read_bytes

#: Compressed bytes of a file, about; payload bytes of a shard: a 64th of all between these bounds; bins that a heavy one is cut into.
FILE_BYTES, SHARD_BYTES, SHARDS, SPLIT = 256 << 20, (8 << 20, 4 << 30), 64, 64
#: Payloads from so many bytes on are kept once.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COMMIT, GENERATION = "_commit-", "generation-"
MANIFEST = "name string, at string, bytes bigint, records bigint, sha256 string"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: bytes) -> str:
    """A UUID of version 8 that holds the page id, whether there is one, and 57 bits of the payload's digest."""
    own = (page_id or 0) & (1 << 64) - 1
    low = (own & 15) << 58 | (page_id is None) << 57 | int.from_bytes(digest[:8]) >> 7
    return str(uuid.UUID(int=own >> 16 << 80 | 8 << 76 | (own >> 4 & 0xFFF) << 64 | 2 << 62 | low))


def page_of(record: str) -> int | None:
    n = uuid.UUID(record).int
    if n >> 57 & 1:
        return None
    own = n >> 80 << 16 | (n >> 64 & 0xFFF) << 4 | n >> 58 & 15
    return own - (1 << 64) if own >> 63 else own


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    sha1 = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'none' if page_id is None else page_id}"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{record_id(page_id, sha1)}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", _base32(sha1)), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{record_id(refers_to, sha1)}>")]
    return _member(headers, block)


def info_member(name: str, date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    own = uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=5)
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


@dataclass
class Shards:
    """Bins by their least id, and the shards of each; rows without an id have bin -1, kept last in the arrays."""

    starts: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    n: int

    def of(self, ids: list[int | None], digests: list[str]) -> np.ndarray:
        known = np.array([i if i is not None else 0 for i in ids], np.int64)
        at = np.maximum(np.searchsorted(self.starts, known, "right") - 1, 0)
        at = np.where([i is None for i in ids], len(self.first) - 1, at)
        mark = np.array([int(d[:12], 16) for d in digests], np.int64)
        return self.first[at] + mark % self.parts[at]


def _histogram(narrow: DataFrame, starts: np.ndarray) -> np.ndarray:
    """Payload bytes of each bin; one row a bin reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(starts, b.column(0).to_numpy(zero_copy_only=False), "right") - 1
            total = np.bincount(at, weights=b.column(1).to_numpy(zero_copy_only=False) + 400.0, minlength=len(starts))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["bin", "bytes"])

    got = narrow.select("page_id", "n").mapInArrow(run, "bin bigint, bytes bigint").groupBy("bin").agg(F.sum("bytes").alias("bytes")).toArrow()
    out = np.zeros(len(starts), np.int64)
    out[got.column("bin").to_numpy()] = got.column("bytes").to_numpy()
    return out


def plan_shards(narrow: DataFrame) -> Shards:
    """narrow: ``page_id``, ``n`` (payload bytes), on storage. The plan depends on nothing but these rows."""
    known = narrow.filter("page_id is not null")
    s = narrow.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum(F.col("n") + 400).alias("bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("n") + 400)).alias("none")).first()
    size = min(SHARD_BYTES[1], max(SHARD_BYTES[0], (s.bytes or 0) // SHARDS))
    starts, ends, total = [], [], np.zeros(0, np.int64)
    if s.low is not None:
        starts, ends = [s.low], [s.high + 1]
        total = _histogram(known, np.array(starts, np.int64))
        # bins of over a quarter of a shard are cut again; their number is bounded by that of the shards
        while any(heavy := [t > size // 4 and e - b > 1 for b, e, t in zip(starts, ends, total, strict=True)]):
            new = []
            for b, e, h in zip(starts, ends, heavy, strict=True):
                step = -(-(e - b) // SPLIT)
                new += [(x, min(e, x + step)) for x in range(b, e, step)] if h else [(b, e)]
            starts, ends = [x[0] for x in new], [x[1] for x in new]
            total = _histogram(known, np.array(starts, np.int64))
    first, parts, shard, held = [], [], 0, 0
    for t in total.tolist():
        if t > size:
            shard += held > 0
            first.append(shard)
            parts.append(-(-t // size))
            shard, held = shard + parts[-1], 0
            continue
        if held + t > size:
            shard, held = shard + 1, 0
        first.append(shard)
        parts.append(1)
        held += t
    shard += held > 0
    first.append(shard)
    parts.append(max(1, -(-(s.none or 0) // size)))
    return Shards(np.array(starts or [0], np.int64), np.array(first, np.int64), np.array(parts, np.int64), shard + parts[-1])


def _writer(root: str, file_bytes: int):
    """Over members sorted by shard: files under temporary names, one manifest row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        temp = f"_temporary/{uuid.uuid4().hex}"
        now: dict | None = None

        def close(f: dict) -> pa.RecordBatch:
            f["out"].close()
            row = [[f["name"]], [f"{temp}/{f['name']}"], [f["size"]], [f["records"]], [f["sha"].hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["name", "at", "bytes", "records", "sha256"])

        def put(f: dict, member: bytes, records: int = 1) -> None:
            f["out"].write(member)
            f["sha"].update(member)
            f["size"] += len(member)
            f["records"] += records

        for b in batches:
            for shard, member in zip(b.column("shard").to_pylist(), b.column("member").to_pylist(), strict=True):
                if now is None or now["shard"] != shard or now["records"] and now["size"] + len(member) > file_bytes:
                    roll = now["roll"] + 1 if now and now["shard"] == shard else 0
                    if now:
                        yield close(now)
                    fs.create_dir(f"{base}/{temp}")
                    name = f"pages-{shard:06d}-{roll:04d}.warc.gz"
                    now = {"shard": shard, "roll": roll, "name": name, "out": fs.open_output_stream(f"{base}/{temp}/{name}", compression=None), "size": 0, "records": 0, "sha": hashlib.sha256()}
                    put(now, info_member(name), 0)
                put(now, member)
        if now:
            yield close(now)

    return run


def _publisher(root: str):
    """Move the files of the manifest into place; a file that is there already was moved by an earlier attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for name, at, size in zip(*(b.column(c).to_pylist() for c in ("name", "at", "bytes")), strict=True):
                here, there = fs.get_file_info([f"{base}/{at}", f"{base}/{name}"])
                if here.is_file:
                    fs.move(here.path, there.path)
                elif not there.is_file or there.size != size:
                    raise OSError(f"{name} is neither under its temporary name nor in place")
            yield b

    return run


def _commits(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removeprefix(COMMIT)) for n in names(spark, root) if n.startswith(COMMIT))


def write(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive ``page_id``, ``url``, ``html`` under ``root``, a URI that executors can write to; returns the manifest.
    An archive that was there before stays until ``vacuum`` and is what readers see until this one is committed.

    A null html is an empty payload; a null url is replaced by one made from the id. Of equal payloads of
    ``LEAST_REVISIT`` bytes and more the row with the largest id is the response; rows that share that id are
    responses all, and if no row has an id all are. Rows alike in id and html share a record id. Further columns are
    ignored; no rows give an empty manifest.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    generation = f"{GENERATION}{uuid.uuid4().hex[:12]}"
    at = f"{root}/{generation}"
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"n": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload"), "more": F.xxhash64("payload")})
    narrow = scratch.cut(own.select("page_id", "n", "sha1", "more"))
    same = ["n", "sha1", "more"]
    tops = narrow.filter(F.col("n") >= LEAST_REVISIT).groupBy(*same).agg(F.max("page_id").alias("top"), F.count("*").alias("copies"))
    tops = scratch.cut(tops.filter("copies > 1 and top is not null").drop("copies"))
    shards = plan_shards(narrow)
    # one row a group of copies; Spark knows its size, broadcasts it if small, and else splits a hot group
    both = own.join(tops, same, "left").select("page_id", "url", "payload", "sha1", "top")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, urls, payloads, digests, top = (c.to_pylist() for c in b.columns)
            out = [page_member(i, u, p, t, t is not None and i != t) for i, u, p, t in zip(ids, urls, payloads, top, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards.of(ids, digests).astype(np.int32)), b.column(0), b.column(3), pa.array(out, pa.binary())], names=["shard", "page_id", "sha1", "member"])

    dealt = both.mapInArrow(members, "shard int, page_id bigint, sha1 string, member binary").repartitionById(shards.n, F.col("shard"))
    # equal ids and digests are equal members, or a response among revisits of its id, so the member ends the order
    rows = dealt.sortWithinPartitions("shard", "page_id", "sha1", F.xxhash64("member")).mapInArrow(_writer(at, file_bytes), MANIFEST)
    rows.write.parquet(f"{at}/_files")
    files = spark.read.schema(MANIFEST).parquet(f"{at}/_files")
    files.mapInArrow(_publisher(at), MANIFEST).select("name", "bytes", "records", "sha256").write.json(f"{at}/_manifest")
    total = _totals(_listed(spark, at))
    remove(spark, f"{at}/_temporary")
    turn = max(_commits(spark, root), default=0) + 1
    while not publish(spark, f"{root}/{COMMIT}{turn:012d}", json.dumps({"generation": generation} | total).encode()):
        turn += 1  # another write took the number
    return manifest(spark, root, turn)


def _listed(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("name string, bytes bigint, records bigint, sha256 string").json(f"{at}/_manifest")


def _totals(files: DataFrame) -> dict[str, int]:
    r = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
    return r.asDict()


def current(spark: SparkSession, root: str, turn: int | None = None) -> dict:
    """The last commit, or that of a number: its generation, and how many files, bytes and records it has."""
    turn = turn or max(_commits(spark, root), default=None)
    if turn is None:
        raise FileNotFoundError(f"no archive is committed under {root}")
    return json.loads(read_bytes(spark, f"{root}/{COMMIT}{turn:012d}"))


def manifest(spark: SparkSession, root: str, turn: int | None = None) -> DataFrame:
    """``name``, ``bytes``, ``records``, ``sha256`` of each file of the last commit; a manifest that lost rows is an error."""
    own = current(spark, root, turn)
    files = _listed(spark, f"{root}/{own['generation']}")
    if _totals(files) != {k: own[k] for k in ("files", "bytes", "records")}:
        raise ValueError(f"the manifest of {own['generation']} is not the one that was committed")
    return files


def vacuum(spark: SparkSession, root: str) -> None:
    """Drop all commits but the last, and the generations, those of broken writes too, that it does not name."""
    turns = _commits(spark, root)
    kept = {f"{COMMIT}{turns[-1]:012d}", current(spark, root)["generation"]} if turns else set()
    for n in names(spark, root):
        if n not in kept and (n.startswith((COMMIT, GENERATION, "_draft-"))):
            remove(spark, f"{root}/{n}")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each gzip member in a stream."""
    z, held = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            held += z.decompress(chunk)
            chunk = z.unused_data
            if not z.eof:
                break
            head, _, rest = bytes(held).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            n = int(fields["content-length"])
            if not lines[0].startswith("WARC/1.") or rest[n:] != b"\r\n\r\n":
                raise ValueError(f"broken record {fields.get('warc-record-id')}")
            yield fields, rest[:n]
            z, held = zlib.decompressobj(31), bytearray()
    if held:
        raise ValueError("the last record is cut off")


def read(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """One row for each response and revisit under ``root``: ``page_id``, ``payload_bytes``, ``payload_digest`` (hex),
    ``record_type``, ``refers_to``, ``url``, ``archive``, and ``payload`` if asked for (null for revisits).

    Block and payload digests are computed again and must agree with the headers, and each file with its size, records
    and hash in the manifest.
    """
    own = current(spark, root)
    folder = f"{root}/{own['generation']}"
    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint", "url": "string", "archive": "string"} | ({"payload": "binary"} if with_payload else {})
    arrow = pa.schema([(k, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[v]) for k, v in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)

        def rows(name: str, known: tuple) -> Iterator[list]:
            sha, size, n = hashlib.sha256(), 0, 0

            def chunks(f) -> Iterator[bytes]:
                nonlocal size
                while chunk := f.read(1 << 20):
                    sha.update(chunk)
                    size += len(chunk)
                    yield chunk

            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                for h, block in records(chunks(f)):
                    if h["warc-type"] == "warcinfo":
                        continue
                    n += 1
                    if _base32(hashlib.sha1(block).digest()) != h["warc-block-digest"]:
                        raise ValueError(f"block digest of {h['warc-record-id']}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = h["warc-type"] == "revisit"
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    if not revisit and (len(payload) != length or _base32(hashlib.sha1(payload).digest()) != h["warc-payload-digest"]):
                        raise ValueError(f"payload digest of {h['warc-record-id']}")
                    digest = base64.b32decode(h["warc-payload-digest"][5:]).hex()
                    to = page_of(h["warc-refers-to"][10:-1]) if revisit else None
                    row = [page_of(h["warc-record-id"][10:-1]), length, digest, h["warc-type"], to, h["warc-target-uri"], name]
                    yield [*row, None if revisit else payload] if with_payload else row
            if (size, n, sha.hexdigest()) != known:
                raise ValueError(f"{name} is not the file of the manifest")

        def batch(held: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

        for b in batches:
            for name, *known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held, size = [], 0
                for r in rows(name, tuple(known)):
                    held.append(r)
                    size += r[1] if with_payload else 1
                    if len(held) >= 10_000 or with_payload and size >= 16 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    # each file is a task's work
    numbered = manifest(spark, root).select("name", "bytes", "records", "sha256").repartition(max(1, min(own["files"], 10_000)))
    return numbered.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


#: What writing and reading back must give.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE n >= {LEAST_REVISIT} GROUP BY html HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN g USING (html)"""
