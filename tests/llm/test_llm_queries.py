"""Registered queries on the smallest tables: SQL, held-out accuracy, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, db, name):
    got, want = q.queries()[name](spark, SF).toPandas(), db.execute(q.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    sort = lambda d: d[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert sort(got).equals(sort(want))


def test_held_out_language(spark):
    got = q.op2_language_id(spark, SF).join(q.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) and (got.lang_pred == got.lang).mean() > 0.95


def test_pipeline_stages(spark):
    docs = q.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS).cache()
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    letters = docs.filter(F.regexp_count("text", F.lit(r"\p{L}")) > 0)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in letters.collect()}
    one = corpus_pipeline.one_of_each(spark, docs, SF).cache()
    sets = {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {r.doc_id for r in one.collect()} == {i for i in ids if root(i) == i}
    clean = corpus_pipeline.private(spark, docs, SF)
    assert clean.filter(F.col("text").rlike(r"\+[0-9][ ().0-9-]{8,}[0-9]")).count() == 0
    assert clean.filter(F.length("text") != F.col("n_chars")).count() == 0
    mixed = corpus_pipeline.weights(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.pieces(spark, docs, SF).filter("exact").count() == docs.count()


def test_pipeline_runs_and_takes_no_rows(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.filter(~F.col("exact")).count() == 0
    for t in ("documents",):
        q.table(spark, SF, t).limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
