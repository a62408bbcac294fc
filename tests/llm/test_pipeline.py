import corpus_pipeline
from quillframe.llm.common import stored
from quillframe.llm import decontam, minhash, toxicity
from quillframe.llm.queries import QUERIES
from tests.conftest import DATA


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1].selectExpr("*", "1 as kept", "2 as score"), DATA).cache()
        assert out.columns == columns, name
        seen.append(out)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    # near-duplicates: what is left has no pair that links, and each group keeps one
    left = minhash.near_duplicates(seen[2])
    assert left.filter("not kept").count() == 0
    groups = {r["component_id"] for r in minhash.near_duplicates(seen[1]).collect()}
    assert groups == ids[2]
    # decontamination: exactly the documents in which an item occurs are gone
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for r in seen[2].collect():
        if any(i in decontam.normal(r["text"]) for i in items):
            assert r["doc_id"] not in ids[3]
    # toxicity: what the model rejects is gone
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).filter("predicted = 1").collect()}
    assert ids[0] - ids[1] == rejected
    # secrets: no planted token is left
    assert seen[4].filter("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, seen[4], DATA).collect()
    assert {r["doc_id"] for r in mixed} == ids[4]


def test_stage_names_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_on_odd_rows(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(60)
    odd = [(None, "a plain text without an id that says little", "en", "s", 5), (-1, None, "en", "s", None), (-2, "", None, None, 0), (-3, "twice the same row of a table", "en", "s", 3), (-3, "twice the same row of a table", "en", "s", 3), (-4, "long words " * 30000, "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = base.unionByName(spark.createDataFrame(odd, schema)).selectExpr("*", "1 as predicted", "2 as leaks", "3 as findings", "4 as clean_text", "5 as kept", "6 as size")
    rows = stored(rows, "odd-rows")
    n = rows.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, DATA)
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect() if r["doc_id"] is not None and r["doc_id"] < 0)
        assert ids == [-4, -3, -3, -2, -1], name
        assert out.filter("doc_id is null").count() == 1, name
        if name != "mixing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.filter("doc_id = -1 and text is null").count() == 1, name
        if name in ("secrets", "mixing"):
            assert out.count() == n
        assert stage(spark, rows.filter("false"), DATA).count() == 0, name
