"""The pipeline against its stages done by brute force."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from kithbase.llm import bpe, features, gam, lexer, mixing, pii

from .test_dedup import classes


def test_pipeline(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = gam.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    import pyarrow as pa

    order = sorted(docs)
    p = model.score(features.features(lexer.Block(pa.array([docs[i].text for i in order]))))
    kept = [(i, docs[i].text) for i, x in zip(order, p) if x >= corpus_pipeline.KEEP]
    home = classes(kept)
    kept = [(i, t) for i, t in kept if home[i] == i]
    field = pii.train()
    kept = [(i, pii.redacted(t, pii.find(field, [t])[0][1])) for i, t in kept]
    frame = spark.createDataFrame([(i, t, docs[i].source) for i, t in kept], "doc_id long, text string, source string")
    times = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(frame).collect()}
    ranks = bpe.Ranks(bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks.tokens)}, special_tokens={})
    want = sorted((i, docs[i].source, hashlib.sha256(np.array(own.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept for _ in range(times[i]))
    assert sorted((r.doc_id, r.source, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(list(r.tokens) == own.encode_ordinary(own.decode(r.tokens)) and len(r.tokens) == r.n_tokens for r in got)


def test_edges(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, clashing columns, empty tables: every stage keeps its columns, and what it must."""
    rows = [(i, t, "en", s, len(t or ""), i, "x") for i, (t, s) in enumerate([(None, "a"), ("", "a"), (" \n", None), ("one two three four five six", "b"), ("mail x@y.org " * 3, "b"), ("word " * 9000, None), ("one two three four five six", "c")])]
    rows += [rows[3], (None, "no id but some words here", None, "a", None, 9, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, cid string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, None, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/a")
        assert out.columns == docs.columns and stage(spark, docs.limit(0), f"{tmp_path}/a").count() == 0, name
        if name == "near_dedup":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
        elif name != "mixture":
            assert out.count() == docs.count()
        if name == "personal_data":
            assert {r.doc_id: r.text for r in out.collect()}[4] == "mail [EMAIL] " * 3
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert all(r.n_tokens == len(r.tokens) for r in got) and {r.doc_id for r in got} <= {None, 0, 2, 3, 4, 5}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
