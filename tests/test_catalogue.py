"""Each registered query against its SQL twin on DuckDB."""

import duckdb
import numpy as np
import pytest

from quarry import catalogue
from quarry.operators import ranking
from quarry.plans import retrieve

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    got = sorted(str(sorted(r.asDict().items())) for r in df.collect())
    rel = duck.sql(catalogue.oracle_sql()[name])
    want = sorted(str(sorted(zip(rel.columns, r, strict=True))) for r in rel.fetchall())
    assert {k: TYPES[v] for k, v in df.dtypes} == {k: str(v) for k, v in zip(rel.columns, rel.types, strict=True)}
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_searches_without_sql_ask_every_hundredth_row(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.round(unit @ unit[i], 6)
        pool = np.lexsort((ids, -score))[:15]
        want[ids[i]] = ids[pool[ranking.mmr_order(score[pool], unit[pool], 8, 0.7)]].tolist()
    got = {}
    for r in catalogue.queries()["mmr_select"](spark, sf).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == want and len(want) > 1
    asked = {r.query_id for r in catalogue.queries()["dense_retrieval_context"](spark, sf).select("query_id").collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    ip = np.round(x @ x.T, 6)
    assert asked == {ids[i] for i in np.flatnonzero(ids % 100 == 0) if docs & set(ids[np.lexsort((ids, -ip[i]))[:15]].tolist())}


def test_hybrid_embeds_whole_passages(spark, sf, monkeypatch):
    asked, was = [], retrieve.embed
    monkeypatch.setattr(retrieve, "embed", lambda *a, **k: asked.append(k.get("most")) or was(*a, **k))
    catalogue.queries()["hybrid_two_stage"](spark, sf)
    assert asked == [None, None]


#: A page whose title was cut inside a reference, references without a name in the list, and controls.
ODD_PAGES = [
    (1, "u1", "<html><head><title>A &amp</title></head><body><article><h1>A &amp</h1><p>b &eacute; &lt;i&gt; c&#39;s</p></article></body></html>"),
    (2, "u2", "<html><head><title>T &quot;q&quot;</title></head><body><article><h1>&copy &amp;lt; h</h1><p>" + "long &nbsp text " * 40 + "</p></article></body></html>"),
]


def odd_pages_equal_sql(spark, tmp_path, name):
    spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = catalogue.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(map(tuple, df.select(rel.columns).collect())) == sorted(rel.fetchall())


def test_tree_index_of_pages_with_cut_references(spark, tmp_path):
    odd_pages_equal_sql(spark, tmp_path, "html_tree_index")


def test_tree_lines_of_pages_with_cut_references(spark, tmp_path):
    odd_pages_equal_sql(spark, tmp_path, "html_tree_lines")
