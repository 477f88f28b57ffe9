"""Content: chunking of byte streams, encoded blobs, varints, checksums, reads at offsets."""

from __future__ import annotations

import hashlib
import hmac
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 64


def _table(seed: int = 1) -> np.ndarray:
    """A 32-bit number for each byte, from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


_NUMBERS = _table()


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """The cyclic hash of the WINDOW bytes that end at each position; 0 before there are so many."""
    h = np.zeros(len(data), dtype=np.uint32)
    n = len(data) - WINDOW + 1
    if n > 0:
        for i in range(WINDOW):
            turn = (WINDOW - 1 - i) % 32
            v = _NUMBERS[data[i : i + n]]
            h[WINDOW - 1 :] ^= (v << np.uint32(turn)) | (v >> np.uint32((32 - turn) % 32)) if turn else v
    return h


def cuts(data: bytes, average: int) -> list[int]:
    """Ends of the chunks of data: content-defined, from average / 4 to average * 4 bytes, the last one shorter.

    A cut falls where the hash of the last WINDOW bytes has its low bits nearly all set; it depends on nothing before them but the last cut.
    """
    if average & (average - 1) or average < 4 * WINDOW:
        raise ValueError("the average must be a power of two, of 256 at least")
    low, high, mask, least = average // 4, average * 4, 2 * average - 1, 2 * average - 3
    marks = np.flatnonzero((rolling_hashes(np.frombuffer(data, dtype=np.uint8)) & np.uint32(mask)) >= least) + 1
    out, at = [], 0
    while at < len(data):
        i = int(np.searchsorted(marks, at + max(low, WINDOW)))
        end = min(int(marks[i]) if i < len(marks) else len(data), at + high, len(data))
        out.append(end)
        at = end
    return out


def chunk_streams(streams: DataFrame, id_col: str, data_col: str, average: int) -> DataFrame:
    """(id, pos, start_off, size, digest) of the content-defined chunks of each stream; an empty or null stream has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for pos, end in enumerate(cuts(data or b"", average)):
                    rows.append((key, pos, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=[id_col, "pos", "start_off", "size", "digest"])

    return streams.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("d")).mapInArrow(run, f"`{id_col}` long, pos long, start_off long, size long, digest string")


def fixed_chunks(streams: DataFrame, id_col: str, data_col: str, size: int) -> DataFrame:
    """(id, pos, start_off, size, digest) of chunks of a fixed size, the last one shorter: DataFrame functions only."""
    own = streams.select(F.col(id_col), F.col(data_col).cast("binary").alias("_d")).where(F.octet_length("_d") > 0)
    each = own.select(id_col, "_d", F.explode(F.sequence(F.lit(0), F.octet_length("_d") - 1, F.lit(size))).alias("at"))
    part = F.substring(F.col("_d"), F.col("at") + 1, F.lit(size))
    return each.select(id_col, (F.col("at") / size).cast("long").alias("pos"), F.col("at").cast("long").alias("start_off"), F.octet_length(part).cast("long").alias("size"), F.sha2(part, 256).alias("digest"))


def read_at(chunks: DataFrame, id_col: str, offset: int, length: int) -> DataFrame:
    """The bytes [offset, offset + length) of each stream from its chunks (id, start_off, data)."""
    end = F.col("start_off") + F.octet_length("data")
    hit = chunks.where((F.col("start_off") < offset + length) & (end > offset))
    start = F.greatest(F.lit(offset) - F.col("start_off"), F.lit(0)).cast("int")
    part = F.substring(F.col("data"), start + 1, (F.least(end, F.lit(offset + length)) - F.col("start_off")).cast("int") - start)
    pieces = F.array_sort(F.collect_list(F.struct("start_off", F.hex(part).alias("h"))))
    return hit.groupBy(id_col).agg(F.unhex(F.array_join(F.transform(pieces, lambda x: x["h"]), "")).alias("data"))


MAGIC = {False: b"TMB0", True: b"TMBZ"}


def encode_blob(data: bytes, compress: bool = True) -> bytes:
    """Magic, CRC-32 of the payload, payload; compressed only where that is smaller."""
    small = zlib.compress(data, 1) if compress else data
    packed = compress and len(small) < len(data)
    payload = small if packed else data
    return MAGIC[packed] + zlib.crc32(payload).to_bytes(4, "little") + payload


def decode_blob(blob: bytes, digest: str | None = None) -> bytes:
    """The data of a blob; ValueError where the magic, the CRC or the digest is wrong."""
    kinds = {m: k for k, m in MAGIC.items()}
    if blob[:4] not in kinds:
        raise ValueError("no blob")
    payload = blob[8:]
    if zlib.crc32(payload).to_bytes(4, "little") != blob[4:8]:
        raise ValueError("wrong CRC")
    data = zlib.decompress(payload) if kinds[blob[:4]] else payload
    if digest is not None and hashlib.sha256(data).hexdigest() != digest:
        raise ValueError("wrong digest")
    return data


def blob_round_trip(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, size, encoded, packed, ok): each value encoded, decoded and compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [d or b"" for d in b.column(1).to_pylist()]
            blobs = [encode_blob(d) for d in data]
            ok = [decode_blob(x, hashlib.sha256(d).hexdigest()) == d for x, d in zip(blobs, data, strict=True)]
            columns = [b.column(0), pa.array([len(d) for d in data], type=pa.int64()), pa.array([len(x) for x in blobs], type=pa.int64()), pa.array([x[:4] == MAGIC[True] for x in blobs]), pa.array(ok)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "size", "encoded", "packed", "ok"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("d")).mapInArrow(run, f"`{id_col}` long, size long, encoded long, packed boolean, ok boolean")


def varint(v: Column) -> Column:
    """Hex of an unsigned number in groups of 7 bits, low ones first, the high bit set on all but the last."""
    low = [F.shiftrightunsigned(v, 7 * i).bitwiseAND(127) for i in range(10)]
    more = [F.shiftrightunsigned(v, 7 * (i + 1)) != 0 if 7 * (i + 1) < 64 else F.lit(False) for i in range(10)]
    there = [F.lit(True), *[m for m in more[:-1]]]
    byte = lambda i: F.lpad(F.hex(F.when(more[i], low[i].bitwiseOR(128)).otherwise(low[i])), 2, "0")
    return F.concat(*[F.when(there[i], byte(i)).otherwise("") for i in range(10)])


def varint_value(h: Column) -> Column:
    """The number of varint()'s hex."""
    n = F.length(h) / 2
    at = F.sequence(F.lit(0), n.cast("int") - 1)
    byte = lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(127)
    return F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", byte(i), (i * 7).cast("int"))))


def signed_varint(v: Column) -> Column:
    """A negative number as its size with all high bits set and a zero byte at the end; others as varint()."""
    digits = varint(F.abs(v))
    marked = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 2), F.lpad(F.hex(F.conv(F.right(digits, F.lit(2)), 16, 10).cast("long").bitwiseOR(128)), 2, "0"), F.lit("00"))
    return F.when(v < 0, marked).otherwise(digits)


def zero_digest(size: int) -> str:
    """Digest of a chunk of zeros."""
    return hashlib.sha256(bytes(size)).hexdigest()


def signature(manifest: str, key: bytes) -> str:
    """HMAC-SHA256 of a manifest's canonical JSON without its unprotected part and signature."""
    own = {k: v for k, v in json.loads(manifest).items() if k not in ("unprotected", "signature")}
    return hmac.new(key, json.dumps(own, sort_keys=True, separators=(",", ":")).encode(), hashlib.sha256).hexdigest()


def pad(key: bytes, with_: int) -> str:
    """Hex of a key's block for HMAC-SHA256, each byte combined with with_."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ with_ for b in block).hex()


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex of a message's HMAC-SHA256, by DataFrame functions only."""
    inner = F.sha2(F.concat(F.unhex(F.lit(pad(key, 0x36))), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(pad(key, 0x5C))), F.unhex(inner)), 256)


def sealed(message: Column, key: Column) -> Column:
    """An authenticated, encrypted blob (AES-256-GCM): a random 12-byte vector, the ciphertext, and the tag."""
    return F.aes_encrypt(message.cast("binary"), key, F.lit("GCM"))


def opened(blob: Column, key: Column) -> Column:
    """The message of sealed(); null where the key or the tag is wrong."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM"))
