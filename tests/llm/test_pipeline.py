"""The pipeline's stages beside plain versions, and on odd rows."""

import collections

import pytest
from pyspark.sql import functions as F
from test_ops import DOCS, ODD, WORD, brute_cut, brute_near, plain

import corpus_pipeline
from wrenfold.llm import mixing
from wrenfold.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = table(spark, sf, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path_factory.mktemp("stage") / f"{k}"))
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_language_keeps_clean(steps):
    before, after = steps[0]
    assert ids(before) == ids(after) and after.columns == before.columns


def test_near_duplicates(steps):
    before, after = steps[1]
    assert ids(after) == brute_near([(r.doc_id, r.text) for r in before.collect()]) and after.columns == before.columns


def test_passages(steps):
    before, after = steps[2]
    want = {i: (t, n, gone) for i, n, gone, t in brute_cut([(r.doc_id, r.text) for r in before.collect()], corpus_pipeline.PASSAGE)}
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == {i for i, (_, n, gone) in want.items() if not gone or gone < n}
    assert all(" ".join(WORD.findall(r.text)) == want[i][0] and (r.n_chars == len(r.text)) for i, r in got.items())


def test_benchmark(steps, spark, sf):
    before, after = steps[3]
    grams = set()
    for r in table(spark, sf, "benchmark").collect():
        w = plain(r.text)
        grams |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    kept = set(ids(after))
    for r in before.collect():
        w = plain(r.text)
        leaks = any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))
        assert not (leaks and r.doc_id in kept)
    assert len(kept) > 0.9 * before.count()


def test_mixture(steps):
    before, after = steps[4]
    rows = after.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert len(WORD.findall(r.text)) == r.words <= r.size and 1 <= r.epoch <= mixing.CAP
    assert all(abs(sum(r.words for r in own) - own[0].target) <= 1 for own in by.values())
    assert set(before.columns) < set(after.columns)


def test_run_equals_stages(steps, spark, sf):
    out = corpus_pipeline.run(spark, sf).select("doc_id", "epoch", "words")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, steps[-1][1].select("doc_id", "epoch", "words").collect()))


def test_odd_rows_and_empty_tables(spark, sf):
    odd = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("size", "epoch", "target", "items", "hits", "k", "rejected", "h", "_plain")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0, name
        out = stage(spark, odd, sf)
        assert out.count() <= 3 * len(ODD) and len(set(out.columns)) == len(out.columns), name
