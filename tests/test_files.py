"""Files of all kinds, broken ones too, and summaries in any order."""

import json

from lorewell.sources import files


def test_documents_of_every_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello\n")
    (tmp_path / "sub" / "b.MD").write_text("# é")
    (tmp_path / "c.json").write_text('{"k":[1,"ü"]}')
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "none").write_text("x")
    got = {r.source_path.rsplit("/", 1)[-1]: r for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].content == "hello\n" and got["b.MD"].content == "# é" and got["a.txt"].document_id == "doc_" + got["a.txt"].content_hash[:16]
    assert got["c.json"].content == json.dumps({"k": [1, "ü"]}, indent=2, ensure_ascii=False)
    assert got["d.pdf"].error == "Unsupported file type: .pdf" and got["none"].error == "Unsupported file type: "
    assert got["bad.json"].error and got["bad.txt"].error and got["bad.txt"].document_id is None
    assert sorted(r.text for r in files.folder_texts(spark, str(tmp_path)).collect()) == sorted(["hello\n", "# é", str({"k": [1, "ü"]})])


def test_summaries_by_chunk(spark, tmp_path):
    (tmp_path / "summaries_s1.json").write_text(json.dumps([{"chunk_index": 2, "summary": "b"}, {"text": "first"}, {"chunk_index": 1, "summary": "a"}]))
    (tmp_path / "raw_s1.json").write_text("[]")
    got = files.load_session_summaries(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.session_id, r.chunk_index, r.summary) for r in got] == [("s1", 0, "first"), ("s1", 1, "a"), ("s1", 2, "b")]


def test_each_message_is_written_by_one_of_many_tasks(spark):
    from lorewell.plans import ingest

    path = ingest.message_files(spark, "/root/testdata/sf0.01")
    names = spark.read.format("binaryFile").load(f"{path}/plain").select("path").collect()
    tasks = {r["path"].rsplit("/", 1)[-1].split("-")[1] for r in names}
    assert len(names) > 100 and len(tasks) == 4 * spark.sparkContext.defaultParallelism


def test_packed_messages_are_the_same_documents_in_few_files(spark):
    from lorewell.plans import ingest

    sf = "/root/testdata/sf0.001"
    told = lambda path: sorted(tuple(r) for r in files.load_documents(spark, path).select("suffix", "content", "content_hash", "error").collect())
    packed = ingest.message_packs(spark, sf)
    assert told(packed) == told(ingest.message_files(spark, sf))
    stored = spark.read.format("binaryFile").load(f"{packed}/_packs/messages").count() + spark.read.format("binaryFile").option("recursiveFileLookup", True).load(packed).count()
    assert stored < 20 < len(told(packed))


def test_files_in_packs_are_read_beside_loose_ones(spark, tmp_path):
    (tmp_path / "a.txt").write_text("loose")
    rows = spark.createDataFrame([("b.txt", b"packed"), ("c.json", b'{"k": 1}'), ("d.json", b"{nope"), ("e.pdf", b"x")], "path string, content binary")
    files.write_pack(rows, str(tmp_path), "one")
    got = {r.source_path.rsplit("/", 1)[-1]: r for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.txt", "b.txt", "c.json", "d.json", "e.pdf"] and got["b.txt"].content == "packed"
    assert got["d.json"].error and got["e.pdf"].error == "Unsupported file type: .pdf"
    assert sorted(r.text for r in files.folder_texts(spark, str(tmp_path)).collect()) == ["loose", "packed", "{'k': 1}"]
