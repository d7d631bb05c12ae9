import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from brackwater import auth
from brackwater.engine import Engine, NotFound
from brackwater.sources import extract
from brackwater.sources.snapshots import Snapshots, want_full
from brackwater.sources.store import Conflict
from brackwater.streaming.jobs import ingest_stream, lifecycle, requeue_running, retained


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def test_a_life_of_documents(engine):
    d = engine.create_domain("notes")
    first = engine.ingest_text(d, "One", "The quick brown fox jumps over the lazy dog.", metadata={"lang": "en"}, labels=["animals", "short"], subdomain="fables")
    assert (first.chunk_count, first.duplicate) == (1, False)
    again = engine.ingest_text(d, "Copy", "The quick brown fox jumps over the lazy dog.")
    assert again.duplicate and again.document_id == first.document_id and again.chunk_count == 0
    other = engine.ingest_text(d, "Two", chunks=["a fox in spring", "  snow, and no animal "], labels=["short"])
    assert other.chunk_count == 2

    hits = engine.search(d, "fox").collect()
    assert {h.text for h in hits} == {"The quick brown fox jumps over the lazy dog.", "a fox in spring", "  snow, and no animal "}
    assert hits[0].snippet is not None
    assert [h.chunk_id >> 20 for h in engine.search(d, "fox", filter="tag:animals AND meta.lang:en").collect()] == [first.document_id]
    assert engine.search(d, "fox", labels=["animals", "none"], match_all=True).count() == 0
    assert engine.search(d, "fox", subdomain="nowhere").count() == 0
    assert {h.chunk_id >> 20 for h in engine.search(d, "fox", document_ids=[other.document_id]).collect()} == {other.document_id}
    with pytest.raises(ValueError):
        engine.search(d, vector=[1.0])
    chunk = (other.document_id << 20) + 1
    assert [r.ordinal for r in engine.chunk_context(chunk).collect()] == [0, 1]

    engine.update_document(other.document_id, labels=["animals"], subdomain="weather")
    tags = engine.tag_ids(d)
    assert engine.get("documents", other.document_id).tags == [tags["animals"]]
    assert {tuple(r.tags) for r in engine.table("chunks", [d]).where(F.col("document_id") == other.document_id).collect()} == {(tags["animals"],)}
    engine.update_tag(tags["animals"], display_name="Beasts")
    assert engine.get("tags", tags["animals"]).display_name == "Beasts"
    engine.delete_tag(tags["animals"])
    assert "animals" not in engine.tag_ids(d) and engine.get("documents", other.document_id).tags == []
    engine.delete_subdomain(engine.subdomain_ids(d)["weather"])
    with pytest.raises(NotFound):
        engine.get("documents", other.document_id)
    assert engine.table("embeddings", [d]).count() == 1
    engine.delete_document(first.document_id)
    assert engine.table("chunks", [d]).count() == 0
    fresh = engine.ingest_text(d, "Again", "The quick brown fox jumps over the lazy dog.")
    assert not fresh.duplicate  # the hash went with its document


def test_several_domains(engine):
    a, b = engine.create_domain("a"), engine.create_domain("b")
    for d, text in ((a, "apples and pears"), (b, "pears and plums")):
        engine.ingest_text(d, "t", text)
    hits = engine.search_multi([a, b, a], "pears").collect()
    assert sorted(h.domain_id for h in hits) == [a, b]
    assert engine.search_multi([], "x").count() == 0
    assert engine.reindex_domain(a) == 1
    engine.rename_domain(a, "new")
    engine.delete_domain(b)
    assert [(r.id, r.name) for r in engine.table("domains").collect()] == [(a, "new")]
    assert engine.table("chunks").count() == 1
    with pytest.raises(NotFound):
        engine.search(b, "x")
    with pytest.raises(ValueError):
        engine.create_domain("c", "no such model")


def test_batches_keep_the_first_of_each_content(spark, engine):
    d = engine.create_domain("batch")
    docs = spark.createDataFrame([(k, f"t{k}", f"text {k % 7}") for k in range(40)], "n int, title string, text string").repartition(5)
    got = {r.n: (r.document_id, r.duplicate) for r in engine.ingest(d, docs).collect()}
    assert [k for k in sorted(got) if not got[k][1]] == list(range(7))
    assert all(got[k][0] == got[k % 7][0] for k in got)
    assert [r.title for r in engine.page("documents", d, 2, 3).collect()] == ["t2", "t3", "t4"]
    assert engine.page("documents", d, -1, 900).count() == 7 and engine.page("documents", d, 0, 5, most=4).count() == 4 and engine.page("documents", d, 0, 5, most=None).count() == 5
    assert engine.counts["ingested"] == 7 and engine.counts["duplicates"] == 33


def test_deletions_and_compaction(engine):
    d = engine.create_domain("x")
    ids = [engine.ingest_text(d, f"t{k}", f"text number {k}").document_id for k in range(3)]
    engine.delete_document(ids[2])
    assert engine.store.table("documents").count() == 3 and engine.count("documents") == engine.count("embeddings", d) == 2
    with pytest.raises(NotFound):
        engine.delete_document(ids[2])
    again = engine.ingest_text(d, "t2", "text number 2")
    assert not again.duplicate and again.document_id == ids[2] + 1
    engine.delete_document(again.document_id)
    engine.delete_document(ids[0])
    engine.compact(d)
    assert engine.store.table("documents").count() == engine.count("chunks") == 1 and len(engine.store.manifest()["chunks"]) == 1
    assert engine.search(d, "text").count() == 1
    assert engine.ingest_text(d, "t3", "text number 3").document_id == again.document_id + 1


def test_a_sealed_store(spark, tmp_path):
    from brackwater.functions.crypto import derive_key

    one, two = derive_key("one", b"s", 10), derive_key("two", b"s", 10)
    e = Engine(spark, f"file://{tmp_path}/store", key=one)
    d = e.create_domain("secret name")
    e.ingest_text(d, "title", "the quick brown fox")
    e.store.rekey(two)
    assert e.search(d, "fox").first().text == "the quick brown fox" and e.get("domains", d).name == "secret name"
    held = spark.read.parquet(*(p for p, _ in e.store.manifest()["chunks"])).first().text
    assert "fox" not in held
    with pytest.raises(Exception):
        Engine(spark, f"file://{tmp_path}/store", key=one).table("chunks").collect()
    e.store.rekey(None)
    assert Engine(spark, f"file://{tmp_path}/store").table("chunks").first().text == "the quick brown fox"


def test_versions_and_backups(engine, tmp_path):
    d = engine.create_domain("v")
    engine.ingest_text(d, "one", "first text")
    snaps = Snapshots(engine.store, f"file://{tmp_path}/backups")
    with pytest.raises(ValueError):
        snaps.differential(1)
    full = snaps.full(1)
    engine.ingest_text(d, "two", "second text")
    diff = snaps.differential(2)
    assert 0 < diff["bytes"] and diff["parent"] == full["id"]
    engine.ingest_text(d, "three", "third text")
    snaps.restore(diff["id"])
    assert engine.table("documents").count() == 2
    snaps.restore(full["id"])
    assert engine.table("documents").count() == 1 and engine.search(d, "first").count() == 1
    engine.store.vacuum(1, list(snaps.manifests()))
    assert engine.table("documents").count() == 1
    for k in range(3):
        snaps.full(10 + k)
    assert snaps.prune(2) == 3 and [r["kind"] for r in snaps.list()] == ["full", "full"]
    with pytest.raises(Conflict):
        engine.store.publish({}, engine.store.version() - 1)
    assert [want_full(n, 3) for n in (1, 2, 3, 4)] == [True, False, False, True] and want_full(5, 1)


def test_files(spark, engine, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.TXT").write_bytes(b"plain \xff text")
    (folder / "b.html").write_text("<title>T</title><script>no()</script><p>One &amp; two</p><p>three</p>")
    with zipfile.ZipFile(folder / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>First &amp;lt; x</w:t></w:p><w:p><w:t>Second</w:t></w:p>")
    (folder / "d.doc").write_bytes(b"x")
    (folder / "e.exe").write_bytes(b"x")
    (folder / "f.docx").write_bytes(b"no zip")
    got = {os.path.basename(r.path): (r.text, r.error) for r in extract.read_files(spark, f"file://{folder}").collect()}
    assert got["a.TXT"] == ("plain � text", None)
    assert got["b.html"][0].split() == ["T", "One", "&", "two", "three"]
    assert got["c.docx"][0] == "First < x\nSecond"
    assert all(got[n][0] is None and got[n][1] for n in ("d.doc", "e.exe", "f.docx"))
    d = engine.create_domain("files")
    stored, failed = engine.ingest_files(d, spark.read.format("binaryFile").load(f"file://{folder}"))
    assert stored.count() == 3 and failed.count() == 3


def test_spreadsheets():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row/><row><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert extract.xlsx_text(data.getvalue()) == "# S\nname |  | 2.5\n | true | \n"


def test_the_queue(spark, engine, tmp_path):
    d = engine.create_domain("q")
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    jobs = [{"job_id": k, "domain_id": d, "title": f"j{k}", "text": f"body {k % 2}"} for k in range(3)] + [{"job_id": 9, "domain_id": 77, "text": "lost"}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, jobs)))
    for _ in range(2):
        ingest_stream(engine, f"file://{inbox}", f"file://{tmp_path}/cp").awaitTermination()
    rows = {r.id: r for r in engine.table("jobs").collect()}
    assert {k: r.status for k, r in rows.items()} == {0: "Done", 1: "Done", 2: "Done", 9: "Failed"}
    assert rows[9].attempts == 3 and "77" in rows[9].error and rows[2].document_id == rows[0].document_id
    assert engine.table("documents").count() == 2
    (inbox / "2.json").write_text("\n".join(map(json.dumps, [jobs[0], {**jobs[1], "job_id": 5, "text": "new body"}])))
    ingest_stream(engine, f"file://{inbox}", f"file://{tmp_path}/cp").awaitTermination()
    assert engine.table("documents").count() == 3 and engine.table("jobs").count() == 5


def test_a_bad_request_fails_alone(spark, tmp_path):
    def chunker(text):
        if "poison" in text:
            raise ValueError("can't be cut")
        return [text]

    engine = Engine(spark, f"file://{tmp_path}/store", chunker=chunker)
    d = engine.create_domain("q")
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    jobs = [{"job_id": k, "domain_id": d, "text": "poison" if k == 2 else f"body {k}"} for k in range(4)] + [{"domain_id": d, "text": "no id"}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, jobs)) + "\n{broken")
    ingest_stream(engine, f"file://{inbox}", f"file://{tmp_path}/cp", max_attempts=1).awaitTermination()
    rows = {r.id: r for r in engine.table("jobs").collect()}
    assert {k: r.status for k, r in rows.items()} == {0: "Done", 1: "Done", 2: "Failed", 3: "Done"}
    assert rows[2].error and engine.count("documents") == 3 == engine.count("chunks", d)


def test_embedded_queries_are_remembered(spark, tmp_path):
    from brackwater import engine as module
    from brackwater.functions.text import mock_embedding

    asked = []

    def embedder(text):
        asked.append(1)
        return mock_embedding(64)(text)

    e = Engine(spark, f"file://{tmp_path}/store", embedders={"mock": embedder})
    first = e.queries("mock", ["a", "b", None, "a"], [None, None, [1.0], None]).collect()
    again = e.queries("mock", ["b", "a"]).collect()
    assert len(asked) == 1 and first[0].vector == first[3].vector == again[1].vector and first[2].vector == [1.0]
    e.queries("mock", ["c"])
    assert len(asked) == 2 and len(e._vectors) == 3
    e.queries("mock", [f"text {k}" for k in range(module.REMEMBERED + 5)])
    assert len(e._vectors) == module.REMEMBERED


def test_jobs_as_rows(spark):
    events = spark.createDataFrame([(1, 1, "claim"), (1, 2, "done"), (2, 1, "claim"), (3, 1, "claim"), (3, 2, "fail"), (4, 1, "claim"), (4, 2, "claim"), (4, 3, "claim"), (4, 4, "fail")], "job_id long, ts long, event_type string")
    assert {r.job_id: (r.status, r.attempts) for r in lifecycle(events).collect()} == {1: ("Done", 1), 2: ("Running", 1), 3: ("Pending", 1), 4: ("Failed", 3)}
    jobs = spark.createDataFrame([(1, "Running", 0), (2, "Done", 10), (3, "Done", 90), (4, "Failed", 5), (5, "Pending", 1)], "id long, status string, updated_at long")
    assert {r.id: r.status for r in requeue_running(jobs).collect()}[1] == "Pending"
    assert {r.id for r in retained(jobs, 100, 50).collect()} == {1, 3, 5}


def test_permissions(spark):
    kind = "scopes array<struct<domain:long,perm:string>>, expires long"
    rows = [([(None, "read")], None), ([(2, "write")], None), ([(3, "admin")], None), ([(None, "admin")], 5), ([], None), (None, None)]
    df = spark.createDataFrame(rows, kind)
    got = [r.a for r in df.select(auth.allows(F.col("scopes"), F.lit(2), "write", F.lit(10), F.col("expires")).alias("a")).collect()]
    assert got == [False, True, False, False, False, False]
    assert [r.a for r in df.select(auth.is_admin(F.col("scopes")).alias("a")).collect()] == [False, False, False, True, False, False]
    token, digest = auth.new_token()
    assert auth.token_hash(token) == digest and len(digest) == 32


def written_by_shuffles(spark, since=-1):
    """(the latest stage, bytes written by shuffles of stages after a given one)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    found = {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}
    return max(found, default=-1), sum(v for k, v in found.items() if k > since)


def test_neither_ingest_nor_search_shuffles_texts(spark, engine):
    d = engine.create_domain("d")
    texts = [" ".join(hashlib.sha256(b"%d %d" % (k, j)).hexdigest() for j in range(150)) for k in range(40)]  # 10 KB each
    docs = spark.createDataFrame([(k, texts[k % 38]) for k in range(40)], "n int, text string")
    since = written_by_shuffles(spark)[0]
    rows = engine.ingest(d, docs).collect()
    assert {r.n: (r.document_id, r.duplicate) for r in rows} == {k: (k % 38 + 1, k >= 38) for k in range(40)}
    assert 0 < written_by_shuffles(spark, since)[1] < 100_000  # of 390 KB of text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = engine.search(d, texts[3][:64], filter="NOT tag:none")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert 4 in {h.chunk_id >> 20 for h in hits.collect()}
        assert not [line for line in plan.split("\n") if "SortMergeJoin" in line and "LeftOuter" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
