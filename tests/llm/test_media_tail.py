"""Operator 2's query: exact columns of odd texts, also of bytes that are no valid UTF-8."""

import hashlib
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

from seqloom.llm import queries

TEXTS = [b"a", b"", None, "é".encode() * 288, b"x" * 576, b"x" * 577, b"y" * 600, b"a\0b", b"ab\xc3", b"\xff\xfe abc", b"\xed\xa0\x80x"]


def test_exact_columns_of_the_query(spark, tmp_path):
    raw = pa.array(TEXTS, pa.binary())
    text = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), raw.null_count)
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": text}), tmp_path / "documents.parquet")
    want = {}
    for i, t in enumerate(TEXTS):
        own = t or b""
        payload = own + b"\xff" * (max(1, -(-len(own) // 576)) * 576 - len(own))
        want[i] = (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    rows = queries.op2_media(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
