"""The pipeline's stages on a small table, against plain versions."""

import corpus_pipeline
from quarry.llm import packing, toxicity
from quarry.llm.queries import remainder
from tests.llm.test_mixing import water_fill
from tests.llm.test_ngram_join import brute
from tests.llm.test_quality import plain


def test_stages(spark, sf, docs):
    from quarry.llm.common import written

    at, seen = docs, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, sf))
        seen.append(at.collect())
        if name != "packing":
            assert at.columns == docs.columns and len(at.dtypes) == len(docs.dtypes)
    raw, mild, good, single, mixed, packed = seen

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, remainder(5) != 0)
    assert sorted(r.doc_id for r in mild) == sorted(r.doc_id for r in raw if model.score(r.text) < 0.5)

    assert not any(plain(r.text)[5] for r in good)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    passed = [r for r in mild if not plain(r.text)[5] and r.doc_id in quality]
    assert {r.doc_id for r in passed if quality[r.doc_id]} <= {r.doc_id for r in good}
    assert not {r.doc_id for r in passed if not quality[r.doc_id]} & {r.doc_id for r in good}

    least = {c for _, _, c in brute([(r.doc_id, r.text) for r in good])}
    assert sorted(r.doc_id for r in single) == sorted(least)

    words = {r.doc_id: plain(r.text)[0] for r in single}
    sizes = {}
    for r in single:
        sizes[r.source] = sizes.get(r.source, 0) + words[r.doc_id]
    for s, target in water_fill(sizes, (5, 2, 1), 3).items():
        got = sum(words[r.doc_id] for r in mixed if r.source == s)
        assert abs(got - target) <= max(60, 0.1 * target)

    enc = packing.encoder(None)
    tokens = sum(len(enc._whole(r.text)) // 4 + 1 for r in mixed)
    assert sum(r.length for r in packed) == tokens
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_odd_rows(spark, sf, edge, none):
    for rows in (edge, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            if name != "packing":
                assert out.columns == rows.columns and out.dtypes == rows.dtypes
            got = out.collect()
            if rows is none:
                assert got == []
            elif name == "quality_rules":
                assert [r.doc_id for r in got] == [4]
            elif name == "toxicity":
                assert len(got) == 9
            elif name == "ngram_jaccard_join":
                # 1, its repeat and 6 have the same words; wordless rows stay.
                assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 4, 5, 7]
            elif name == "source_mixing":
                assert {r.doc_id for r in got} <= {1, 4, 6, 7, None}
            else:
                assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, None} and max(r.length + r.offset for r in got) <= 2048
