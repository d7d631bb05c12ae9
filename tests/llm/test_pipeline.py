import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from brackwater.llm import decontaminate, linededup, minhash, pieces, toxicity


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """What each stage was given and what it gave."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, data).write.parquet(path)
        given, docs = docs, spark.read.parquet(path)
        out.append((name, given, docs))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_takes_what_the_one_before_kept(spark, data, stages):
    assert [n for n, *_ in stages] == [n for n, _ in corpus_pipeline.STAGES]
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    for _, given, gave in stages[:-1]:
        assert given.columns == gave.columns == columns
        assert ids(gave) <= ids(given)


def test_decisions_take_effect(spark, data, stages):
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, last) = stages
    model = toxicity.fit(d0, spark.read.parquet(f"{data}/labels.parquet"))
    assert ids(d1) == {r.doc_id for r in toxicity.score(d0, model).collect() if not r.toxic}
    dropped = {r.doc_id: r.lines for r in linededup.repeated_lines(d1).collect()}
    texts1, texts2 = ({r.doc_id: r.text for r in d.collect()} for d in (d1, d2))
    assert all(texts2[k] == t for k, t in texts1.items() if k not in dropped)
    assert all(texts2[k] == linededup.without(texts1[k], dropped[k]) for k in dropped if k in texts2)
    assert ids(d3) == ids(d2) - {r.doc_id for r in minhash.groups(d2).collect() if not r.kept}
    held = {r.doc_id for r in decontaminate.find(d3, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert ids(d4) == ids(d3) - held
    back = {r.doc_id: r.text for r in pieces.decode(last).collect()}
    assert back == {r.doc_id: r.text for r in d4.collect()}


def test_run_is_the_stages(spark, data, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, stages[-1][2].collect()))


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_run_on_tables_without_texts(spark, data, tmp_path, kind):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{data}/{name}.parquet").limit(5)
        df = df.where("false") if kind == "empty" else df.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.ids, r.pieces) for r in got] == ([] if kind == "empty" else [(None, None, 0)] * 5)


def test_copies_of_any_length_are_dropped(spark, docs_of, words, data):
    text = words(120, 1)
    rows = [(1, " ".join(text)), (2, " ".join(words(400, 2) + text + words(400, 3))), (3, " ".join(words(500, 4)))]
    assert ids(corpus_pipeline.drop_near_copies(spark, docs_of(rows), data)) == {1, 3}
