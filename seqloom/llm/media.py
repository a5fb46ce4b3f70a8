"""Media columns: payloads in tar shards, addressed by their content (operator 2).

A payload is an 8-bit greyscale PNG under the hash of its samples.  Each scanning task streams the payloads of its rows into
tar shards of its own in the shared folder, each distinct one once, and returns where they lie (digest, shard, offset, length);
an attempt that fails leaves a shard that no row names.  The catalog keeps one place for each digest, whatever the number of
rows and tasks that met it: all rows with equal payloads carry the same place.  (Payloads never cross the network.  A payload
that several tasks met lies in a shard of each, at most once a task; only one copy is named.)  Metadata come from reads of the
first 33 bytes at each offset; a whole payload is read only when features are wanted.

Edge cases: a null text is empty; an empty payload is one row of padding; a very long text is one payload; repeated rows share a
stored payload, and of several places (ties) the catalog names the least; a null doc_id stays null; an empty table makes no shard;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import column_bytes
from .shared import filesystem, stage

WIDTH = 576
PAD = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20
SEEN = 1_000_000
CATALOG = "digest string, shard string, offset long, length long"
HEADER = CATALOG + ", width int, height int, bit_depth int, colour_type int"
FEATURES = HEADER + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray) -> bytes:
    """A greyscale PNG of WIDTH columns; the samples are a positive multiple of WIDTH."""
    rows = len(samples) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = samples.reshape(rows, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a PNG as encode_png() writes it (no filters, no interlacing)."""
    width, height, depth, colour = read_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or colour or lines[:, 0].any():
        raise ValueError("a PNG of another kind")
    return lines[:, 1:].reshape(-1)


def payload_column(text: Column) -> Column:
    """The text's bytes as they are stored (UTF-8, also where they are no valid one) with bytes PAD up to a positive multiple of WIDTH."""
    n = F.octet_length(text)
    pad = F.greatest(F.ceil(n / F.lit(WIDTH)), F.lit(1)) * WIDTH - n
    return F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit(f"{PAD:02X}"), pad.cast("int"))))


def _tar_header(name: str, size: int) -> bytes:
    import tarfile

    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One or more shards for a task; rows come out once their shard is closed."""
    fs, path = filesystem(folder)
    seen: set[bytes] = set()
    out, name, at, rows = None, "", 0, []
    schema = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def close():
        nonlocal out, rows
        out.write(bytes(1024))
        out.close()
        done, out, rows = rows, None, []
        return pa.RecordBatch.from_pylist(done, schema)

    for batch in batches:
        raw, off = column_bytes(batch.column("payload"))
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            samples = raw[a:b]
            key = hashlib.sha256(samples).digest()
            if key in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(key)
            if out is None:
                fs.create_dir(path, recursive=True)
                name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                out = fs.open_output_stream(f"{path}/{name}")
            data = encode_png(samples)
            head = _tar_header(key.hex() + ".png", len(data))
            out.write(head)
            out.write(data)
            out.write(bytes(-len(data) % 512))
            rows.append({"digest": key.hex(), "shard": f"{folder}/{name}", "offset": at + len(head), "length": len(data)})
            at += len(head) + len(data) + -len(data) % 512
            if at >= SHARD_BYTES:
                yield close()
    if out is not None:
        yield close()


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, a 16-bin histogram in hundredths, and which of 64 blocks are lighter than the mean."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(samples))
    spread = math.sqrt(max(0.0, float((counts * values**2).sum() / len(samples)) - mean * mean))
    blocks = samples.reshape(64, -1).sum(1, dtype=np.int64) * 64 > int(counts @ values)
    shares = ",".join(str(int(x)) for x in counts.reshape(16, 16).sum(1) * 100 // len(samples))
    return f"{mean:.3f};{spread:.3f};{-float((p * np.log2(p)).sum()):.3f};{shares};{int(''.join('01'[int(b)] for b in blocks), 2):016x}"


def _read(batches: Iterator[pa.RecordBatch], whole: bool, tail: int = WIDTH) -> Iterator[pa.RecordBatch]:
    opened: dict[str, object] = {}
    for batch in batches:
        out = batch.to_pydict()
        extra: dict[str, list] = {
            k: [] for k in (
                "width", "height", "bit_depth", "colour_type",
                *(("payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature") if whole else ())
            )
        }
        for shard, offset, length in zip(out["shard"], out["offset"], out["length"], strict=True):
            if shard not in opened:
                if len(opened) >= 64:
                    opened.popitem()[1].close()
                fs, path = filesystem(shard)
                opened[shard] = fs.open_input_file(path)
            f = opened[shard]
            f.seek(offset)
            for k, v in zip(("width", "height", "bit_depth", "colour_type"), read_header(f.read(HEADER_BYTES)), strict=True):
                extra[k].append(v)
            if whole:
                f.seek(offset)
                data = f.read(length)
                samples = decode_png(data)
                for k, v in (
                    ("payload_bytes", len(samples)), ("payload_sha256", hashlib.sha256(samples).hexdigest()),
                    ("tail_crc32", zlib.crc32(samples[-tail:])),
                    ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", features(samples))
                ):
                    extra[k].append(v)
        cols = out | extra
        ints = {"width", "height", "bit_depth", "colour_type"}
        longs = {"offset", "length", "payload_bytes", "tail_crc32"}
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int32() if k in ints else pa.int64() if k in longs else pa.string()) for k, v in cols.items()],
            [*cols]
        )


def store(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Write the payloads; returns the catalog (digest, shard, offset, length) with a row for each distinct one, itself a
    table in the folder."""
    rows = docs.select(payload_column(F.coalesce(F.col(text), F.lit(""))).alias("payload")).mapInArrow(partial(_write, folder=f"{folder}/shards"), CATALOG)
    written = stage(rows, f"{folder}/written")
    one = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return stage(one.select("digest", "place.*"), f"{folder}/catalog")


def headers(catalog: DataFrame) -> DataFrame:
    """The catalog with width, height, bit depth and colour type, from reads of the headers alone."""
    return catalog.repartition(F.col("digest")).sortWithinPartitions("shard", "offset").mapInArrow(partial(_read, whole=False), HEADER)


def read_back(catalog: DataFrame, tail: int = WIDTH) -> DataFrame:
    """The catalog with header columns and features of the stored payloads; tail_crc32 is that of the last ``tail`` samples (1 to WIDTH)."""
    return catalog.repartition(F.col("digest")).sortWithinPartitions("shard", "offset").mapInArrow(partial(_read, whole=True, tail=tail), FEATURES)


def attach(docs: DataFrame, catalog: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's id, unpadded size and its payload's catalog row, met by the digest of its own padded bytes."""
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(payload_column(own), 256).alias("digest"))
    return rows.join(catalog, "digest", "left")
