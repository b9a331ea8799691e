"""The pipeline's run() against a version of SQL and plain loops, stage by stage on the smallest tables."""

import struct
import zlib

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from test_near import brute
from tokenizers import Tokenizer

import corpus_pipeline
from kinema.llm import oracle

SF = "/root/testdata/sf0.001"


def sql(query, docs, tmp_path):
    pq.write_table(pa.Table.from_pylist(docs), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    c.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    r = c.sql(query)
    return [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]


def test_run(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    kept = {r["doc_id"] for r in sql(oracle.OP7, docs, tmp_path) if r["kept"]}
    docs = [d for d in docs if d["doc_id"] in kept]
    text = {r["doc_id"]: r["text"] for r in sql(oracle.OP10, docs, tmp_path)}
    docs = [d | {"text": text[d["doc_id"]]} for d in docs]
    stay, _ = brute([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if d["doc_id"] in stay]
    bad = {r["doc_id"] for r in sql(oracle.OP4, docs, tmp_path) if r["contaminated"]}
    docs = [d for d in docs if d["doc_id"] not in bad]
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d in docs:
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((d["doc_id"], k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert len(ends) <= -(-sum(r.length for r in rows) // 4096) + 1
