"""The pipeline against a brute-force version of its stages, and its stages on edge cases."""

import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline as P
from moltrail.llm import decontaminate, quality

from .test_operators import WORD, brute_similar, brute_spans


@pytest.fixture()
def folder(spark, edge, edge_rows, tmp_path):
    d = str(tmp_path)
    edge.write.parquet(f"{d}/documents.parquet")
    passage = next(t for i, t, *_ in edge_rows if i == 9)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(20, 32)] + [(11, 0, 0), (7, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, edge, edge_rows, folder):
    docs = edge
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == edge.columns, name
        docs = spark.createDataFrame(out.collect(), edge.schema)
    rows = P.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, P.run(spark, folder).collect()))


def test_run_against_brute_force(spark, edge, edge_rows, folder):
    model = quality.train(edge, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(i, t) for i, t, *_ in edge_rows if model.scores([(t or "").encode()])[0] >= 0.3]
    root = brute_similar(rows)
    rows = [(i, t) for i, t in rows if i is None or root[i] == i]
    passage = next(t for i, t, *_ in edge_rows if i == 9)
    rows = [(i, t) for i, t in rows if passage not in (t or "")]

    def size(t):
        out, at = "", 0
        for start, _, kind, end in brute_spans(t):
            if start >= at:
                out, at = out + (t or "")[at:start] + f"[{kind}]", end
        out += (t or "")[at:]
        return len(WORD.findall(re.sub(r"DE89( \d{4}){4} 00", "[iban]", out)))

    assert Counter((r["doc_id"], r["size"]) for r in P.run(spark, folder).collect()) == Counter((i, size(t)) for i, t in rows)


def test_empty_tables(spark, empty, folder):
    docs = empty
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
