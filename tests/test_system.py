import json
import shutil
import zlib

import pytest

from corvane import cli
from corvane import collection as C
from corvane.operators import evaluate
from corvane.sources import config, files, reports, tables
from corvane.sources.tables import IntegrityError, Tables
from corvane.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a b.txt").write_text("  Vectors are compared by their angle. Graphs find them fast.  ", encoding="utf-8")
    (d / "bad.txt").write_bytes(b"\xff\xfe\x00bad\xff")
    (d / "n.md").write_text("# Spark\n\nIt has **partitions** and shuffles.", encoding="utf-8")
    (d / "p.pdf").write_bytes(files.sample_pdf(["First (page)", "", "Third page"]))
    (d / "w.docx").write_bytes(files.sample_docx([("Heading1", "Title"), ("", "Some text"), [["a", "b"], ["c", ""], ["", ""]]]))
    (d / "broken.docx").write_bytes(b"no zip")
    (d / "z.xyz").write_text("?")
    return d


def test_scan(spark, folder):
    rows = {r["doc_id"]: r for r in files.scan_directory(spark, str(folder), ("txt", "markdown", "pdf", "docx")).collect()}
    assert rows["a_b.txt"]["text"].startswith("Vectors") and rows["a_b.txt"]["size"] == len(rows["a_b.txt"]["text"])
    assert rows["n.md"]["text"] == "# Spark It has partitions and shuffles."
    assert rows["p.pdf"]["text"] == "--- Page 1 --- First (page) --- Page 3 --- Third page"
    assert rows["w.docx"]["text"] == "# Title Some text [TABLE] a | b c | |"
    assert rows["bad.txt"]["text"] is None and rows["bad.txt"]["error"] and "DOCX" in rows["broken.docx"]["error"] and "z.xyz" not in rows
    assert files.loaded(files.scan_directory(spark, str(folder))).count() == 1
    assert files.scan_directory(spark, str(folder / "none")).count() == 0
    assert files.pdf_metadata((folder / "p.pdf").read_bytes())["Title"] == "Sample"
    assert files.docx_metadata((folder / "w.docx").read_bytes()) == {"title": "Sample"}
    for bad in (b"x", b"%PDF /Encrypt 1 0 R"):
        with pytest.raises(ValueError):
            files.pdf_text(bad)


def pdf_with_streams():
    """Two pages in an object stream, the second by number first, with hexadecimal strings and a font with a map to Unicode."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    objects = {
        7: b"<< /Type /Page /Parent 2 0 R /Contents 10 0 R >>", 3: b"<</Type/Page/Parent 2 0 R/Contents [11 0 R]>>", 1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [7 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 5 0 R >> >> >>", 5: b"<< /Type /Font /ToUnicode 12 0 R >>",
    }
    head, data = b"", b""
    for n, body in objects.items():
        head, data = head + b"%d %d " % (n, len(data)), data + body + b" "
    stream = lambda n, s, extra=b"": b"%d 0 obj << /Length %d %s >>\nstream\n" % (n, len(s), extra) + s + b"\nendstream endobj\n"
    packed = stream(20, zlib.compress(head + data), b"/Type /ObjStm /N 5 /First %d /Filter /FlateDecode" % len(head))
    shown = stream(10, b"BT /F1 9 Tf <000100020003> Tj T* [(\\000\\001) -300 <0002>] TJ ET") + stream(11, b"BT <48656C6C6F> Tj (a\\)b (c)) ' ET")
    return b"%PDF-1.5\n" + packed + shown + stream(12, cmap) + stream(30, b"", b"/Type /XRef /Root 1 0 R")


def test_pdf_page_tree_and_fonts():
    assert files.pdf_text(pdf_with_streams()) == "--- Page 1 --- Hij H i --- Page 2 --- Hello a)b (c)"
    assert files.pdf_text(files.sample_pdf([f"page {k}" for k in range(12)])).count("--- Page") == 12


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for d in ("b", "a"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "x.txt").write_text(f"text of {d}")
    docs = files.scan_directory(spark, str(tmp_path / "in"), recursive=True)
    assert [r["text"] for r in files.loaded(docs).collect()] == ["text of a", "text of b"]
    c = C.create_collection(spark, f"file://{tmp_path}/db", "one", "brute_force")
    assert c.add_documents(docs)["new_documents"] == 2 and c.info()["num_documents"] == 2
    twice = spark.createDataFrame([("same", "a b"), ("same", "c d"), (None, "x")], "doc_id string, text string")
    assert c.add_documents(twice)["new_documents"] == 1 and c.add_documents(twice)["updated_documents"] == 0
    assert [r["text"] for r in c.tables.load("chunks", "one").where("doc_id = 'same'").collect()] == ["c d"]


def test_graph_with_replaced_vectors_gives_all_results(spark, tmp_path):
    c = C.create_collection(spark, f"file://{tmp_path}", "live", "hnsw")
    text = lambda k, word: f"{word} number {k}"
    c.add_documents(spark.createDataFrame([(f"d{k}", text(k, "apple" if k < 8 else "pear")) for k in range(120)], "doc_id string, text string"))
    c.add_documents(spark.createDataFrame([(f"d{k}", text(k, "plum")) for k in range(8)], "doc_id string, text string"))
    assert int(c.tables.info("indexes", "live")["properties"]["stale"]) == 8
    q = spark.createDataFrame([(0, "apple number 3")], "query_id long, query string")
    for k in (3, 120):
        found = c.search(q, k, least=-1.0).collect()
        assert len(found) == k and sorted(r["rank"] for r in found) == list(range(1, k + 1)) and not any("apple" in r["text"] for r in found)
    # The index is compared with its manifest when it is read.
    part = c.tables.info("indexes", "live")["parts"][0]["path"]
    spark.read.parquet(f"file://{tmp_path}/indexes/live/{part}").limit(0).write.mode("overwrite").parquet(f"file://{tmp_path}/indexes/live/{part}x")
    shutil.rmtree(tmp_path / "indexes" / "live" / part)
    (tmp_path / "indexes" / "live" / f"{part}x").rename(tmp_path / "indexes" / "live" / part)
    with pytest.raises(IntegrityError):
        C.load_collection(spark, f"file://{tmp_path}", "live").search(q, 3)


def test_checksum_sees_pairs_of_equal_rows(spark):
    a, b = ([(x,) for x in xs] for xs in ((1, 1, 2), (3, 3, 2)))
    assert tables.checksum(spark.createDataFrame(a, "x long")) != tables.checksum(spark.createDataFrame(b, "x long"))


def test_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LONG_LOG", 4)
    t = Tables(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, embedding array<float>")
    m = t.save("embeddings", "c", rows, "embedding", model="m")
    assert (m["rows"], m["dimension"]) == (2, 2) and t.exists("embeddings", "c") and t.list("embeddings") == ["c"]
    assert t.load("embeddings", "c", verify=True).count() == 2
    t.upsert("embeddings", "c", spark.createDataFrame([("b", [9.0, 9.0]), ("d", [5.0, 6.0])], rows.schema))
    assert {r["chunk_id"]: r["embedding"][0] for r in t.load("embeddings", "c").collect()} == {"a": 1, "b": 9, "d": 5}
    info = t.info("embeddings", "c")
    assert [(p["removes"], p["rows"]) for p in info["parts"]] == [(None, 2), ("chunk_id", 1), (None, 2)] and info["rows"] == 3 and info["properties"] == {"model": "m"}
    for n in range(4):
        t.upsert("embeddings", "long", spark.createDataFrame([("b", [float(n), 0.0])], rows.schema))
    assert len(t.info("embeddings", "long")["parts"]) <= 4 and t.load("embeddings", "long").first()["embedding"] == [3.0, 0.0]
    assert t.prune("embeddings", "long") > 0 and t.load("embeddings", "long", verify=True).count() == 1
    with pytest.raises(ValueError):
        t.save("embeddings", "c", rows.unionByName(spark.createDataFrame([("x", [1.0])], rows.schema)), "embedding")
    assert t.load("embeddings", "c").count() == 3  # the last whole version stays
    rows.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/embeddings/c/{t.info('embeddings', 'c')['parts'][-1]['path']}")
    with pytest.raises(IntegrityError):
        t.load("embeddings", "c", verify=True)
    assert t.delete("embeddings", "c") and t.info("embeddings", "c") is None
    with pytest.raises(FileNotFoundError):
        t.load("embeddings", "c")
    with pytest.raises(ValueError):
        t.exists("embeddings", "../x")


@pytest.mark.parametrize("algorithm", ["brute_force", "hnsw"])
def test_collection(spark, tmp_path, algorithm):
    root = f"file://{tmp_path}"
    c = C.create_collection(spark, root, "main", algorithm, chunk_size=40, chunk_overlap=5)
    docs = spark.createDataFrame([("x", "red apples grow on old trees in the garden"), ("y", "graphs and vectors are searched by distance"), ("e", "")], "doc_id string, text string")
    q = spark.createDataFrame([(0, "vectors and graphs"), (1, "red apples")], "query_id long, query string")
    assert c.search(q).count() == 0
    first = c.add_documents(docs)
    assert first["new_documents"] == 3 and first["new_chunks"] == first["new_embeddings"] == 4
    again = c.add_documents(docs)
    assert again["new_documents"] == again["updated_documents"] == again["new_chunks"] == 0
    top = {r["query_id"]: r["doc_id"] for r in c.search(q, 1).collect()}
    assert top == {0: "y", 1: "x"}
    before = {r["chunk_id"] for r in c.tables.load("chunks", "main").where("doc_id = 'y'").collect()}
    changed = c.add_documents(spark.createDataFrame([("x", "blue plums")], docs.schema))
    assert (changed["updated_documents"], changed["new_chunks"]) == (1, 1)
    chunks = c.tables.load("chunks", "main")
    assert {r["chunk_id"] for r in chunks.where("doc_id = 'y'").collect()} == before and chunks.where("doc_id = 'x'").count() == 1
    assert c.vectors().count() == chunks.count() == c.info()["num_embeddings"]

    class Client:
        calls = 0

        def generate(self, prompt):
            Client.calls += 1
            assert "plums" in prompt
            return "They are blue [1], not [9]."

    c.cache = __import__("corvane.operators.cache", fromlist=["AnswerCache"]).AnswerCache()
    a = c.answer("blue plums?", Client(), 1)
    assert a["sources"][0]["cited"] and a["warnings"] and a["level"] and not a["cached"]
    assert c.answer(" Blue plums? ", Client(), 1)["cached"] and Client.calls == 1
    assert C.load_collection(spark, root, "main").algorithm == algorithm
    with pytest.raises(ValueError):
        C.load_collection(spark, root, "none")
    C.delete_collection(spark, root, "main")
    assert C.list_collections(spark, root).count() == 0


def test_streaming_ingest(spark, tmp_path, folder):
    c = C.create_collection(spark, f"file://{tmp_path}/t", "s", "brute_force")
    run = lambda: ingest.index_stream(c, str(folder), str(tmp_path / "ck"), ("txt", "markdown")).awaitTermination()
    run()
    assert c.info()["num_documents"] == 2
    (folder / "new.txt").write_text("one more")
    run()
    assert c.info()["num_documents"] == 3


def test_stream_of_messages(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "m" * 8) for i in range(7)], "conv_id long, turn long, role string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    q = ingest.live_history(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2, 100).writeStream.format("memory").queryName("hist").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT num_messages FROM hist").first()[0] == 3


def test_messages_of_one_batch_are_put_in_order(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in reversed(range(10))], "conv_id long, turn long, role string, text string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    q = ingest.live_history(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3, 100).writeStream.format("memory").queryName("ordered").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.sql("SELECT history FROM ordered").first()[0].split("\n") == [f"{'user' if i % 2 == 0 else 'assistant'}: m{i}" for i in range(4, 10)]


def test_command_line(spark, tmp_path, folder, capsys):
    root = ["--root", f"file://{tmp_path}/db"]

    def run(*args, **options):
        code = cli.main([*root, *args], spark, **options)
        return code, capsys.readouterr().out

    assert "valid" in run()[1]
    assert "vectors" in run("preview", str(folder / "a b.txt"))[1].lower()
    assert "num_embeddings" in run("embed-demo", "a b", "c")[1]
    code, out = run("index", "k", str(folder), "--test-query", "vectors angle")
    assert code == 0 and "failed" in out and "new_documents" in out
    assert "a_b.txt" in run("search", "k", "vectors angle", "--export", f"file://{tmp_path}/out")[1]
    assert json.loads(spark.read.text(f"file://{tmp_path}/out").first()[0])["collection"] == "k"
    assert '"k"' in run("list")[1] and "num_chunks" in run("info", "k")[1]

    class Client:
        def generate(self, prompt):
            return "So it is [1]."

    assert "[1]" in run("generate", "k", "vectors?", client=Client())[1]
    says = iter(["vectors?", "and?", "clear", "exit"])
    assert run("chat", "k", client=Client(), ask=lambda _: next(says))[1].count("So it is") == 2
    assert run("search", "none", "x")[0] == 1
    assert "deleted" in run("delete", "k")[1]


def test_benchmark_and_reports(spark, tmp_path):
    r = evaluate.run_benchmark(spark, evaluate.BenchmarkConfig(200, 16, 10, [5], [50], ef_construction=50))
    assert r.rows[1]["recall_mean"] > 0.8 and r.table(spark).count() == 2
    assert r.build_seconds["brute_force"] > 0 and r.to_dict()["build_speedup"] > 0
    assert [x.config.n_vectors for x in evaluate.compare_algorithms(spark, (30, 60), dimension=8, n_queries=5, k_values=[1], ef_values=[10])] == [30, 60]
    assert json.loads(reports.to_json(r, tmp_path / "r.json"))["rows"] and reports.to_table(r).startswith("| algorithm")
    assert reports.to_table(r, "csv").count("\n") == 3 and "vectors" in reports.console(r) and "n=200" in reports.comparison([r])


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("ingestion:\n  chunk_size: 100\n")
    c = config.load_config(tmp_path / "c.yaml")
    assert c["ingestion"] == config.DEFAULTS["ingestion"] | {"chunk_size": 100} and config.project_info(c)["name"] == "corvane"
    assert all(p.is_dir() for p in config.create_directories(c, tmp_path))
    log = config.setup_logging(c, tmp_path)
    config.log_config(c, log)
    assert "chunk_size" in (tmp_path / "logs" / "corvane.log").read_text()
    (tmp_path / "bad.yaml").write_text("ingestion:\n  chunk_overlap: 9999\n")
    with pytest.raises(ValueError):
        config.load_config(tmp_path / "bad.yaml")
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.yaml")


def test_event_stream_matches_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("ts", events["ts"].cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    plain = lambda rows: sorted((str(r["window_start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in rows)
    assert plain(spark.sql("SELECT * FROM windows").collect()) == plain(ingest.event_windows(events).collect())
