"""The corpus pipeline against its stages by brute force, and the registered queries against DuckDB."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from corvane.llm import mixing, oracle
from corvane.llm.queries import oracle_sql, queries, vocabulary

SF = "/root/testdata/sf0.001"


def database() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_there_is_a_query_for_each_operator():
    assert [int(q[2:].split("_")[0]) for q in queries()] == list(range(1, 11))


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_oracle(spark, name):
    found = queries()[name](spark, SF)
    want = database().execute(oracle_sql()[name]).fetchall()
    cols = [c[0] for c in database().execute(oracle_sql()[name]).description]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in found.collect()))) == sorted(map(str, want))


def test_pipeline(spark):
    from tests.llm.test_pairs_and_spans import components, leaving

    con = database()
    docs = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracle.QUALITY}) WHERE kept").fetchall()}
    docs = [d for d in docs if d[0] in kept]
    docs = [d for d, c in zip(docs, components(docs), strict=True) if c == d[0]]
    gone = leaving([d[:2] for d in docs], con.execute("SELECT item_id, text FROM benchmark").fetchall())
    docs = [d for d in docs if d[0] not in gone]

    out = corpus_pipeline.run(spark, SF).collect()
    taken, texts = Counter(r.doc_id for r in out), {d[0]: d[1] for d in docs}
    assert set(taken) <= set(texts) and max(taken.values()) <= 3
    size, words, largest = Counter(), Counter(), Counter()
    for i, t, s in docs:
        n = len(t.split())
        size[s] += n
        words[s] += n * taken[i]
        largest[s] = max(largest[s], n)
    for s, goal in mixing.targets(dict(size)).items():
        assert abs(words[s] - goal) <= largest[s]
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(vocabulary()), 0
    library.encode_special_tokens = True
    for r in sorted(out, key=lambda r: r.start):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_delete_what_those_before_them_left(spark):
    """Only the result of the last stage and the token files stay."""
    from corvane.llm.scratch import shared_root

    root = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {x.getPath().getName().split("-")[0] for x in files.listStatus(root)}
    with_old = {x.getPath().getName() for x in files.listStatus(root)} if files.exists(root) else set()
    corpus_pipeline.run(spark, SF)
    assert {x.getPath().getName().split("-")[0] for x in files.listStatus(root) if x.getPath().getName() not in with_old} == {"tokens"} and names()
