"""Deterministic sharded WARC writer and reader.

The writer range-sorts the records: ids are cut into shards of about equal payload by a histogram of ids, whose cells are cut again
where they hold more than a shard, so shards don't depend on sampling, on the number of tasks or on far ids. One id (or no id) with more
than a shard of records is dealt over several shards by its records' URL and payload. A task writes a shard's records in order, each as a gzip member of its own, and
rolls to the next file at a compressed size. Headers, record ids and digests are made anew from the content, without clock or
random numbers. A file is written under a temporary name and renamed when complete; the manifest is written last, and the
reader believes the manifest only. A repeated or lost task writes the same bytes under the same final names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stash

#: Cells of the first histogram of ids, and at least of each later one; the driver gets a few cells for each shard beside.
CELLS = 1 << 16
SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
#: Payloads under this many bytes are never stored as revisits.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, part int, records long, raw_bytes long, gz_bytes long, sha256 string, first_id long, last_id long"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None, str | None] | None) -> bytes:
    """One WARC/1.1 record. refers: (id, URL) of the response with the same payload, for a revisit."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is None:
        block += payload
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(*refers, digest)), ("X-Refers-To-Id", refers[0])]
    head += [("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", len(payload)), ("X-Id", page_id), ("Content-Length", len(block))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


class _Roller:
    """Writes one shard's records into numbered files; rows() has the manifest rows of closed ones."""

    def __init__(self, base: str, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.base, self.most, self.shard, self.out, self.closed = base, file_bytes, None, None, []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:08d}-{self.part:05d}.warc.gz"
        self.temp = f"{self.root}/.{self.name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.out, self.sha, self.size, self.raw, self.ids = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, []

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.closed.append((self.name, self.shard, self.part, self.count, self.raw, self.size, self.sha.hexdigest(), *self.ids))
            self.out = None

    def add(self, shard: int, page_id: int | None, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.size >= self.most:
            self.close()
            self.part += 1
        if self.out is None:
            self._open()
            self.count = 0
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(record) + pack.flush()
        self.out.write(data)
        self.sha.update(data)
        self.size, self.raw, self.count = self.size + len(data), self.raw + len(record), self.count + 1
        self.ids = [self.ids[0] if self.ids else page_id, page_id]

    def rows(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out


class Shards(NamedTuple):
    """starts: first id of each run of shards, sorted; first: its first shard; spread: the shards that its ids are dealt over; nulls: those of null ids, from 0."""

    starts: np.ndarray
    first: np.ndarray
    spread: np.ndarray
    nulls: int


def _shards(pages: DataFrame, shard_bytes: int) -> Shards:
    """Cuts of rows (id, html) into shards, from histograms of payload bytes."""
    sizes = stash(pages.groupBy("id").agg(F.sum(F.octet_length("html") + 400).alias("size")), "page-sizes")
    nulls = sizes.where("id is null").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    low, high = sizes.agg(F.min(F.shiftright("id", 1)), F.max(F.shiftright("id", 1))).first()
    leaves: list[tuple[int, int, bool]] = []  # (first id, bytes, whether it is one id)
    if low is not None:
        width = (high - low) // CELLS + 1  # ids are halved at first, so that no difference overflows
        rows = sizes.where("id is not null").select("id", "size", F.expr(f"(shiftright(id, 1) - {low}L) div {width}L").alias("cell"))
        spans = {}
        found = rows.groupBy("cell").agg(F.sum("size")).collect()
        for cell, size in found:
            spans[cell] = (2 * (low + cell * width), 2 * width, size)
        while spans:
            heavy = {c: x for c, x in spans.items() if x[2] > shard_bytes and x[1] > 1}
            leaves += [(a, size, width == 1) for c, (a, width, size) in spans.items() if c not in heavy]
            if not heavy:
                break
            table, parts, base = [], {}, 0
            for c, (a, width, size) in sorted(heavy.items()):
                step = -(-width // max(2 * -(-size // shard_bytes), CELLS // len(heavy)))
                table.append((c, a, step, base))
                parts[base] = (a, step)
                base += -(-width // step)
            cuts = rows.sparkSession.createDataFrame(table, "cell long, a long, step long, base long")  # fewer rows than shards
            rows = rows.join(F.broadcast(cuts), "cell").select("id", "size", F.expr("base + (id - a) div step").alias("cell"))
            bases, spans = np.array(sorted(parts)), {}
            for cell, size in rows.groupBy("cell").agg(F.sum("size")).collect():
                base = int(bases[np.searchsorted(bases, cell, "right") - 1])
                a, step = parts[base]
                spans[cell] = (a + (cell - base) * step, step, size)
    forget(sizes)
    spread_nulls = max(1, -(-int(nulls) // shard_bytes))
    starts, first, spread = [], [], []
    shard, held = (spread_nulls, int(nulls) if spread_nulls == 1 else None) if nulls else (0, None)  # held: bytes of the shard that may take more
    for a, size, single in sorted(leaves):
        many = -(-size // shard_bytes) if single else 1
        if held is None or many > 1 or held + size > shard_bytes:
            starts.append(a)
            first.append(shard)
            spread.append(many)
            shard, held = shard + many, size if many == 1 else None
            continue
        if not starts:  # beside the rows of null ids
            starts.append(a)
            first.append(shard - 1)
            spread.append(1)
        held += size
    return Shards(*(np.array(x, dtype=np.int64) for x in (starts, first, spread)), spread_nulls)


def _runs(shards: Shards) -> Callable[[Column], Column]:
    """A function of an id column: the first shard of the id's run, and how many there are."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(shards)  # a few numbers for each shard

    @F.pandas_udf("first long, spread long")
    def run(ids: pd.Series) -> pd.DataFrame:
        s, known = sent.value, ids.notna().to_numpy()
        first, spread = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), s.nulls, dtype=np.int64)
        if known.any():
            at = np.maximum(np.searchsorted(s.starts, ids[known].astype("int64").to_numpy(), "right") - 1, 0)
            first[known], spread[known] = s.first[at], s.spread[at]
        return pd.DataFrame({"first": first, "spread": spread})

    return run


def write_warc(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row under base (a URI that every executor can write to) and returns the manifest, read from base/manifest.

    The payload is html in UTF-8; null is as empty. Of rows with equal payloads of LEAST_REVISIT bytes or more, that of the smallest
    id (then URL; null ids last) is a response and the others revisit it; rows equal in id, URL and payload are alike. A null
    URL gives no target header; rows of null ids are in the first shards, without an id header; a very long payload is one record; an empty
    table gives an empty manifest; other columns aren't read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    shards = _shards(rows, shard_bytes)
    run_of, tasks = _runs(shards), min(max(shards.nulls, int((shards.first + shards.spread).max(initial=0))), 1 << 15)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "url")
    narrow = rows.where(F.octet_length("html") >= LEAST_REVISIT).select("id", "url", F.sha2("html", 256).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = narrow.join(first, "digest").where(~order.eqNullSafe(F.col("first")))
    marks = again.select("id", "url", F.lit(None).cast("string").alias("html"), F.col("first.id").alias("to_id"), F.col("first.url").alias("to_url"), "digest", F.lit(0).alias("kind")).distinct()
    wide = rows.select("*", F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("string").alias("to_url"), F.lit(None).cast("string").alias("digest"), F.lit(1).alias("kind"))
    # a mark goes to all shards of its id's run, a row to the one of its URL and payload
    marks = marks.withColumn("_run", run_of(F.col("id"))).withColumn("shard", F.explode(F.expr("sequence(_run.first, _run.first + _run.spread - 1)")))
    wide = wide.withColumn("_run", run_of(F.col("id"))).withColumn("shard", F.col("_run.first") + F.pmod(F.xxhash64("url", "html"), F.col("_run.spread")))
    merged = marks.drop("_run").unionByName(wide.drop("_run"))
    dealt = merged.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), F.col("url").asc_nulls_first(), "kind", "digest", F.xxhash64("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, marked, key = _Roller(base, file_bytes), {}, None
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                if key != (r["shard"], r["id"], r["url"]):
                    key, marked = (r["shard"], r["id"], r["url"]), {}
                if not r["kind"]:
                    marked[r["digest"]] = (r["to_id"], r["to_url"])
                    continue
                payload = r["html"].encode()
                refers = marked.get(hashlib.sha256(payload).hexdigest()) if marked else None
                roller.add(r["shard"], r["id"], make_record(r["id"], r["url"], payload, refers))
        roller.close()
        if done := roller.rows():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string() if n in ("file", "sha256") else pa.int32() if n == "part" else pa.int64()) for n, c in zip(names, zip(*done, strict=True), strict=True)], names=names)

    _make_dir(spark, base)
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{base}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def _make_dir(spark: SparkSession, base: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(base)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def _members(stream) -> Iterator[bytes]:
    """The records of a file of gzip members; holds one record."""
    held, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = held or stream.read(1 << 20)
        held = b""
        if not data:
            break
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            held, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []


_STATUS = re.compile(rb"HTTP/1\.\d [^\r]*\r\n(?:[^\r]+\r\n)*\r\n")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record. Raises ValueError where lengths or digests disagree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    block = rest[:size]
    if not version.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken WARC record {headers.get('WARC-Record-ID')}")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {headers.get('WARC-Record-ID')}")
    payload = block[_STATUS.match(block).end() :]
    if headers["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {headers.get('WARC-Record-ID')}")
    return headers, payload


RECORD = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string, file string"


def read_warc(manifest: DataFrame, base: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the manifest's files, lengths and digests verified. payloads: with the responses' payloads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RECORD.split(", ")]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)

        for b in batches:
            for f, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(f"{root}/{f}", compression=None) as stream:
                    for record in _members(stream):
                        h, payload = parse_record(record)
                        number = {k: int(h[k]) if k in h else None for k in ("X-Id", "X-Refers-To-Id")}
                        response = h["WARC-Type"] == "response"
                        rows.append((number["X-Id"], h.get("WARC-Target-URI"), h["WARC-Type"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), number["X-Refers-To-Id"], payload.decode() if payloads and response else None, f))
                        seen, held = seen + 1, held + len(payload) * payloads
                        if held > 1 << 24 or len(rows) >= 5000:
                            yield emit(rows)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{f} has {seen} records; the manifest says {records}")
                yield emit(rows)

    files = max(1, min(manifest.count(), 1 << 15))  # a file of bounded size for each task
    return manifest.select("file", "records").repartition(files, "file").mapInArrow(run, RECORD)
