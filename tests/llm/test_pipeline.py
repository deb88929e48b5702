"""The pipeline against a version that runs each stage in SQL or plain Python."""

import zlib

import numpy as np

import corpus_pipeline
from ledgerline.llm import decontaminate, lines, packing, quality, token_counts
from ledgerline.llm.simhash import fingerprint
from tests.llm.test_operators import brute_lanes


def test_pipeline_by_brute_force(spark, sf, duck):
    con = duck.cursor()
    con.execute(f"CREATE TEMP TABLE s1 AS SELECT d.* FROM documents d JOIN ({quality.quality_sql()}) q USING (doc_id) WHERE q.keep")
    con.execute(f"CREATE TEMP TABLE s2 AS {lines.line_dedup_sql('s1')}")
    texts = dict(con.execute("SELECT doc_id, text FROM s2").fetchall())
    component = brute_lanes({d: fingerprint(t or "", corpus_pipeline.WORDS, corpus_pipeline.LANES) for d, t in texts.items()})
    kept = [d for d in texts if component[d] == d]
    con.execute("CREATE TEMP TABLE ids (doc_id BIGINT)")
    con.executemany("INSERT INTO ids VALUES (?)", [(d,) for d in kept])
    con.execute("CREATE TEMP TABLE s3 AS SELECT * FROM s2 WHERE doc_id IN (SELECT doc_id FROM ids)")
    leaking = {r[0] for r in con.execute(decontaminate.leaks_sql("s3")).fetchall()}
    tok, want = token_counts.library(packing.default_path()), set()
    for d in kept:
        if d not in leaking:
            ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [1]
            want |= {(d, k, len(ids[4096 * k : 4096 * k + 4096]), zlib.crc32(np.array(ids[4096 * k : 4096 * k + 4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert 0 < len(kept) < duck.execute("SELECT count(*) FROM documents").fetchone()[0] and leaking


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
