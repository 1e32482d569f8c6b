import corpus_pipeline
from tabwright.llm import queries


def test_stages(llm):
    sf = "/root/testdata/sf0.001"
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(llm, kept, sf).cache()
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema], name
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](llm, kept, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}
    whole = corpus_pipeline.run(llm, sf)
    rows = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert rows(whole) == rows(packed)


def test_odd_rows(messy, empty, llm):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, messy, "/root/testdata/sf0.001")
        assert out.count() > 0, name
        assert stage(llm, empty, "/root/testdata/sf0.001").count() == 0, name


def test_all_operators_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
