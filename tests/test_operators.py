import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ann, cache, chunking, context, conversation, embed, evaluate, generation, incremental, knn, prompts, retrieval
from corvane.plans import registry
from corvane.sources import synthetic


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chunk_lengths(spark):
    text = "x" * 59
    rows = chunking.chunk_documents(docs(spark, text), 30, 10).orderBy("index").collect()
    assert [(r["start"], len(r["text"])) for r in rows] == [(0, 30), (20, 30), (40, 19)]
    counts = chunking.chunk_documents(docs(spark, "y" * 462, "y" * 512, "y" * 1025, "", " \n", None)).groupBy("doc_id").count().orderBy("doc_id").collect()
    assert [r["count"] for r in counts] == [1, 2, 3]
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_documents(docs(spark, "a"), size, overlap)


def test_chunk_table_function(spark):
    chunking.register_sql(spark)
    rows = spark.sql("SELECT * FROM chunk_text('ab  cd ef', 'd', 4, 1)").collect()
    assert [r["text"] for r in rows] == ["ab c", "cd e", "ef"]
    assert spark.sql("SELECT * FROM chunk_text('', 'd', 4, 1)").count() == 0


def test_statistics_of_nothing(spark):
    assert tuple(chunking.chunk_statistics(docs(spark).limit(0)).first()) == (0, 0, 0.0, 0, 0)
    assert tuple(evaluate.recall_statistics(spark.createDataFrame([], "recall double")).first()) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("strategy", ["expression", "blas"])
def test_knn_against_numpy(spark, metric, strategy, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BYTES", 300)  # several blocks
    r = np.random.default_rng(1)
    v, q = r.normal(size=(60, 8)).round(3), r.normal(size=(7, 8)).round(3)
    v[10] = v[20]  # a tie
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node_id long, embedding array<double>").repartition(3)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    s = {"cosine": (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1), "dot": q @ v.T, "euclidean": -np.linalg.norm(q[:, None] - v[None], axis=2)}[metric]
    want = {(i, k + 1): j for i in range(7) for k, j in enumerate(sorted(range(60), key=lambda j: (-round(s[i, j], 9), j))[:5])}
    got = {(x["query_id"], x["rank"]): x["node_id"] for x in knn.knn_join(qs, vs, 5, metric, strategy=strategy).collect()}
    assert got == want
    with pytest.raises(ValueError):
        knn.knn_join(qs, vs, 0)
    assert knn.knn_join(qs, vs.limit(0), 5, metric, strategy=strategy).count() == 0


def test_vector_store(spark):
    s = knn.create_vector_store(spark, 2)
    assert s.add([1, 0], {"chunk_id": "a"}) == 0 and s.add_batch([[0, 1], [1, 1]]) == [1, 2] and len(s) == 3
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert [r["node_id"] for r in s.search(q, 2).orderBy("rank").collect()] == [0, 2]
    assert s.get(0)["metadata"] == {"chunk_id": "a"} and s.statistics().first()["num_vectors"] == 3
    for bad in (lambda: s.add([1]), lambda: s.add_batch([[1, 2]], []), lambda: knn.create_vector_store(spark, 2, "hnsw"), lambda: knn.VectorStore(spark, 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        s.get(3)


def test_hnsw_recall(spark):
    v = synthetic.random_vectors(spark, 600, 16, seed=1).cache()
    q = synthetic.queries(spark, 40, 16, seed=2, dataset=v, noise=0.1).cache()
    truth = knn.knn_join(q, v, 10)
    index = ann.HNSWIndex.build(v, shards=3, ef_construction=80)
    index.graphs = index.graphs.cache()
    recall = {ef: evaluate.recall_statistics(evaluate.recall_table(truth, index.search(q, 10, ef), 10)).first()["recall_mean"] for ef in (10, 100)}
    assert recall[100] >= 0.95 and recall[100] >= recall[10] - 0.02
    stats = index.statistics().orderBy("layer").collect()
    assert stats[0]["num_nodes"] == 600 and stats[0]["avg_neighbors"] > 5
    assert ann.hnsw_nodes(index.graphs).count() == 600
    assert ann.hnsw_edges(index.graphs).where("src = dst").count() == 0
    ivf = evaluate.recall_statistics(evaluate.recall_table(truth, ann.ivf_search(v, q, 10, 8, 6), 10)).first()["recall_mean"]
    assert ivf >= 0.9
    assert ann.search_hnsw(index.graphs.limit(0), q, 5).count() == 0


def test_ivf_recall_as_registered(spark, sf_dir):
    v = registry.vectors(spark, sf_dir)
    found = registry.ivf_search(spark, sf_dir).cache()
    truth = knn.knn_join(registry.asked(v), v, 5)
    assert evaluate.recall_statistics(evaluate.recall_table(truth, found, 5)).first()["recall_mean"] >= 0.9
    assert found.select("query_id", "node_id").distinct().count() == found.count()


def test_keys_fall_into_different_partitions(spark):
    for n in (1, 3, 16):
        keys = ann._spread(n)
        rows = spark.createDataFrame([(k,) for k in keys], "id long").select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) == sorted(ann._partition(r["id"], n) for r in rows)
    one = spark.range(16).withColumn("x", F.col("id").cast("int"))
    assert ann._dealt(one, F.col("x"), 16).groupBy(F.spark_partition_id()).count().count() == 16


def test_recall_of_hard_queries():
    """Noise of 0.1 a coordinate, in 384 dimensions: queries are far from the vectors that they come from."""
    r = np.random.default_rng(0)
    v = r.normal(size=(1000, 384))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = v[r.integers(0, 1000, 100)] + 0.1 * r.normal(size=(100, 384))
    truth = np.argsort(-(q / np.linalg.norm(q, axis=1, keepdims=True)) @ v.T, axis=1)[:, :5]
    g = ann.Graph.bulk(v)
    again = ann.Graph.restore(v, g.levels, *g.edges())
    for ef, least in ((10, 0.88), (50, 0.96), (100, 0.98)):
        found = [[n for _, n in again.search(x, 5, ef)] for x in q]
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, truth, strict=True)]) >= least, ef
    assert found[0] == [n for _, n in g.search(q[0], 5, 100)]


def test_graph_alone():
    g = ann.Graph(3, "euclidean", m=4, ef_construction=20)
    assert g.search([0, 0, 0]) == []
    for x in np.random.default_rng(0).normal(size=(50, 3)):
        g.insert(x)
    d = np.linalg.norm(g.vectors[:50], axis=1)
    assert [n for _, n in g.search([0, 0, 0], 3, 50)] == np.argsort(d)[:3].tolist()
    with pytest.raises(ValueError):
        g.insert([1, 2])
    with pytest.raises(ValueError):
        g.search([0, 0, 0], 0)


def test_recall_and_precision(spark):
    def lists(a, b):
        rows = lambda xs: spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(xs)], "query_id long, rank int, node_id long")
        return rows(a), rows(b)

    assert tuple(evaluate.recall_table(*lists([1, 2, 3, 4, 5], [1, 2, 6, 7, 8]), 5).first()) == (0, 0.4, 0.4)
    assert tuple(evaluate.recall_table(*lists([1, 2, 3], [1, 2, 3]), 10).first()) == (0, 0.3, 1.0)
    assert tuple(evaluate.recall_table(*lists([1, 2, 3], []), 10).first()) == (0, 0.0, 0.0)
    with pytest.raises(ValueError):
        evaluate.recall_at_k("a", "b", 0)


def test_context_limits(spark):
    rows = spark.createDataFrame([(0, 1, "aaaa"), (0, 2, "bb"), (0, 3, "c"), (1, 1, "x" * 50)], "query_id long, rank int, text string")
    got = {r["query_id"]: r["context"] for r in context.contexts(rows, 14).collect()}
    assert got == {0: "[1] aaaa\n\n[2] bb"}
    assert context.contexts(rows, 0).where("query_id = 0").first()["num_sources"] == 3


def prune_slowly(lengths, max_turns, max_tokens):
    turns = [lengths[i : i + 2] for i in range(0, len(lengths), 2)][-max_turns:]
    while len(turns) > 1 and sum(n // 4 for t in turns for n in t) > max_tokens:
        turns = turns[1:]
    return sum(map(len, turns))


def test_pruning_like_a_loop(spark):
    r = random.Random(5)
    cases = [[r.randrange(0, 300) for _ in range(r.randrange(1, 15))] for _ in range(150)]
    rows = spark.createDataFrame([(c, t, "user", "x" * n) for c, case in enumerate(cases) for t, n in enumerate(case)], "conv_id long, turn long, role string, text string")
    kept = {x["conv_id"]: x["count"] for x in conversation.prune(rows, 4, 200).groupBy("conv_id").count().collect()}
    assert kept == {c: prune_slowly(case, 4, 200) for c, case in enumerate(cases)}


def test_live_conversation(tmp_path, spark):
    c = conversation.Conversation(max_turns=2, max_tokens=10)
    for i in range(4):
        c.add_turn(f"question {i}", "a" * 30)
    assert c.stats()["num_turns"] == 1  # the last turn stays, whatever its size
    c.save(tmp_path / "s" / "c.json")
    again = conversation.Conversation.load(tmp_path / "s" / "c.json")
    assert again == c and again.formatted().startswith("user: question 3") and again.rows(spark, 7).count() == 2
    c.clear()
    assert c.history() == []


def test_incremental(spark):
    a, b = docs(spark, "one", "two", "three"), docs(spark, "one", "2", "three", "four")
    m = incremental.manifest_of(a, 512, 50)
    assert {r["doc_id"]: r["reason"] for r in incremental.rechunk_decisions(b, m, 512, 50).collect()} == {0: "unchanged", 1: "changed", 2: "unchanged", 3: "new"}
    assert {r["reason"] for r in incremental.rechunk_decisions(a, m, 256).collect()} == {"parameters"}
    assert incremental.changed_documents(a, m, 512, 50).count() == 0


def test_embedding(spark):
    e = embed.HashEmbedder(16)
    rows = embed.embed_texts(spark, e, ["a b c", "a b d", "x y z", "", "A  b c"])
    v = {r["id"]: np.array(r["embedding"]) for r in rows.collect()}
    assert np.allclose(v[0], v[4]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[3].any() and v[0] @ v[1] > v[0] @ v[2] - 0.5
    assert embed.verify_determinism(e, rows.select("id", "text"))
    model = embed.PythonEmbedder("len", 2, lambda: lambda texts: [[len(t), 1] for t in texts], normalize=False)
    assert {r["id"]: r["embedding"] for r in model.embed(rows.select("id", "text")).collect()}[0] == [5.0, 1.0]


def test_templates(spark, tmp_path):
    t = prompts.PromptTemplate("{% if a %}A={{ a }}{% else %}none{% endif %};{% for x in xs %}<{{ x.n }}>{% endfor %};{{ d | default('?') }}")
    assert t.render(a=1, xs=[{"n": 2}, {"n": 3}]) == "A=1;<2><3>;?"
    assert t.render() == "none;;?" and t.variables() == {"a", "xs", "d"}
    for bad in ("{{ x", "{% if a %}", "{% nope %}", "{{ a + b }}"):
        with pytest.raises(ValueError):
            prompts.PromptTemplate(bad)
    assert prompts.validate_template(prompts.load_template("qa")) == []
    assert prompts.validate_template(t) == ["context", "query"]
    with pytest.raises(ValueError):
        prompts.load_template("poem")
    (tmp_path / "x.j2").write_text("{{ query }}!")
    rows = spark.createDataFrame([("hi",)], "query string")
    assert prompts.render_rows(rows, prompts.load_custom_template(tmp_path / "x.j2")).first()["prompt"] == "hi!"
    for name in prompts.TEMPLATES:
        got = spark.createDataFrame([("ctx", "q", "past")], "context string, query string, history string").select(prompts.prompt(name, history="history").alias("p")).first()["p"]
        assert got == prompts.load_template(name).render(context="ctx", query="q", history="past")


def test_cache():
    now = [0.0]
    c = cache.AnswerCache(2, 10, lambda: now[0])
    c.set("a", 1, "x"), c.set("b", 2, "y")
    assert c.get("a") == 1
    c.set("c", 3)
    assert c.get("b") is None and "a" in c
    now[0] = 11
    assert c.get("a") is None and c.stats()["hits"] == 1 and c.stats()["misses"] == 2
    c.set("d", 4, "x")
    assert c.invalidate_collection("x") == 1 and not c.invalidate("d")
    c.clear(), c.reset_stats()
    assert len(c) == 0 and c.stats()["hit_rate"] == 0


def test_replay_agrees_with_fold(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = cache.replay(events, "user_id", "event_type", "ts", "event_id", 10_000, 86400).select("user_id", "hits", "total")
    b = cache.ttl_hits(events, "user_id", "event_type", "ts", "event_id", 86400).select("user_id", "hits", "total")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_replay_evicts_like_a_loop(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_type", F.concat("event_type", F.lit("-"), F.col("event_id") % 3))
    log = {}
    for r in events.orderBy("ts", "event_id").collect():
        log.setdefault(r["user_id"], []).append((r["ts"].timestamp(), r["event_type"]))
    want = {}
    for user, requests in log.items():
        held, hits = {}, 0  # in order of use
        for at, key in requests:
            stored = held.pop(key, None)
            hit = stored is not None and at - stored <= 7 * 86400
            hits += hit
            held[key] = stored if hit else at
            if len(held) > 3:
                del held[next(iter(held))]
        want[user] = hits, len(requests)
    got = cache.replay(events, "user_id", "event_type", "ts", "event_id", 3, 7 * 86400).collect()
    assert {r["user_id"]: (r["hits"], r["total"]) for r in got} == want and sum(h for h, _ in want.values()) > 0


def test_keys_that_are_expressions(spark):
    rows = lambda xs: spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(xs)], "query_id long, rank int, chunk string")
    key = F.split("chunk", "_")[0]
    r = evaluate.recall_table(rows(["a_1", "b_1"]), rows(["a_2", "c_1"]), 2, key).first()
    assert (r["recall"], r["precision"]) == (0.5, 0.5)


def test_cited_sources_only(spark):
    rows = spark.createDataFrame([(0, 1, "d1", 0.5, "x"), (0, 2, "d2", 0.25, "y")], "query_id long, rank int, doc_id string, score double, text string")
    answers = spark.createDataFrame([(0, "so [2].")], "query_id long, answer string")
    marked = context.mark_cited(context.sources(rows), answers)
    assert [r["doc_id"] for r in context.cited_only(marked).collect()] == ["d2"]
    assert context.format_sources(marked, only_cited=True).first()["display"] == "✓ [2] d2 (score 0.25): y"


def test_store_options(spark):
    s = knn.create_vector_store(spark, 2)
    rows = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0])], "o long, embedding array<double>")
    s.add_table(rows, order="o")
    s.add_table(rows.limit(0))
    assert len(s) >= 2 and s.get(0)["embedding"] == [1.0, 0.0]
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert s.search(q, 1, return_scores=False, return_vectors=True).columns == ["query_id", "rank", "node_id", "metadata", "embedding"]
    with pytest.raises(Exception):
        s.add_table(spark.createDataFrame([([1.0],)], "embedding array<double>")) or s.rows.collect()


def test_equal_keys_have_a_stated_winner(spark):
    new = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], "chunk_id string, x int")
    for n in (1, 3):
        assert [tuple(r) for r in incremental.upsert(new.limit(0), new.repartition(n)).collect()] == [("a", 3)]


def test_blocks_of_queries_are_bounded(spark, monkeypatch):
    """Many more queries than a block holds, and slices of vectors: no matrix of scores is larger than CELLS."""
    monkeypatch.setattr(knn, "QUERY_ROWS", 16)
    monkeypatch.setattr(knn, "CELLS", 64)
    seen = []
    plain = knn.scores
    monkeypatch.setattr(knn, "scores", lambda q, v, *a: (seen.append(len(q) * len(v)), plain(q, v, *a))[1])
    r = np.random.default_rng(0)
    best = knn.Best(r.normal(size=(16, 4)), 3, "cosine")
    best.add(np.arange(50), r.normal(size=(50, 4)))
    assert len(seen) > 10 and max(seen) <= 64 and len(best.row) == 48
    monkeypatch.undo()
    monkeypatch.setattr(knn, "QUERY_ROWS", 16)
    v = synthetic.random_vectors(spark, 90, 4, seed=2)
    q = v.withColumnRenamed("node_id", "query_id")
    got = knn.knn_join(q, v, 2).where("rank = 1").collect()
    assert len(got) == 90 and all(r["query_id"] == r["node_id"] for r in got)
    index = ann.HNSWIndex.build(v, shards=2)
    assert index.search(q, 1).where("query_id = node_id").count() == 90


def test_inverted_lists_of_nothing_and_of_any_metric(spark):
    v = synthetic.random_vectors(spark, 300, 8, seed=5).withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("node_id") % 5)))
    q = v.where("node_id % 7 = 0").withColumnRenamed("node_id", "query_id")
    for metric in ("cosine", "euclidean", "dot"):
        truth = knn.knn_join(q, v, 5, metric)
        found = ann.ivf_search(v, q, 5, metric=metric)
        assert evaluate.recall_statistics(evaluate.recall_table(truth, found, 5)).first()["recall_mean"] >= 0.9, metric
    assert ann.ivf_search(v.limit(0), q, 5).count() == 0 and ann.ivf_search(v, q.limit(0), 5).count() == 0
    assert ann.nearest_cells(v.limit(0), 4).count() == 0 and ann.nearest_cells(v, 4).where("cell between 0 and 3").count() == 300
    assert ann.HNSWIndex.build(v.limit(0)).search(q, 3).count() == 0


def test_inverted_lists_find_what_exact_search_finds(spark):
    """With all cells probed; a third of the rows are copies. Pairs are not rows of a join."""
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 6))[r.integers(0, 200, 600)].round(2) + 0.001
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "node_id long, embedding array<float>")
    q = v.where("node_id % 3 = 0").withColumnRenamed("node_id", "query_id")
    for metric in ("cosine", "euclidean", "dot"):
        found = ann.ivf_search(v, q, 4, 9, 9, metric)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan
        rows = [sorted(map(tuple, f.collect())) for f in (found, knn.knn_join(q, v, 4, metric))]
        assert rows[0] == rows[1] and len(rows[0]) == 800, metric


def test_best_of_slices(monkeypatch):
    """Against all pairs, with copies over many slices and parts of the queries."""
    r = np.random.default_rng(4)
    monkeypatch.setattr(knn.Best, "HELD", 20)
    x, ids = r.normal(size=(30, 5))[r.integers(0, 30, 400)], r.permutation(400)
    q, asked = r.normal(size=(40, 5)), r.random((40, 8)) < 0.6
    for metric in ("cosine", "euclidean", "dot"):
        best = knn.Best(q, 6, metric)
        for i, own in enumerate(np.split(np.arange(400), 8)):
            best.add(ids[own], x[own], np.flatnonzero(asked[:, i]))
        for j in range(40):
            own = np.flatnonzero(np.repeat(asked[j], 50))
            s = knn.pair_scores(np.repeat(q[j : j + 1], len(own), 0), x[own], metric, False)
            assert best.node[best.row == j].tolist() == ids[own][np.lexsort((ids[own], -s))[:6]].tolist()
    nodes, block = knn.first_copies(np.arange(9)[::-1], np.repeat(np.eye(3), 3, 0), 2)
    assert nodes.tolist() == [7, 6, 4, 3, 1, 0] and len(block) == 6


def test_probes_find_all_ranks_and_leave_a_margin(spark):
    v = synthetic.random_vectors(spark, 60, 4, seed=6)
    q = v.withColumnRenamed("node_id", "query_id")
    assert ann.ivf_search(v, q, 5, 60, 1).count() == 300
    # 95 of 100 queries find theirs in the first cell and the others in the second.
    centers, asked = np.eye(2), np.array([[1.0, 0.5]] * 100)
    truth, cells = np.arange(100), np.array([0] * 95 + [1] * 5)
    assert ann._probes(asked, cells, truth, centers, "cosine", 0.95, 100) == 1
    assert ann._probes(asked, cells, truth, centers, "cosine", 0.95, 100_000) == 2
    copies = spark.range(40).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert len(ann.centroids(copies, 2, sample=10, key="node_id")) == 2


def test_many_queries_have_the_vectors_dealt(spark):
    v = synthetic.random_vectors(spark, 400, 4, seed=7).coalesce(1).select("node_id", F.col("embedding").alias("v"))
    q = v.select(F.col("node_id").alias("query_id"), F.col("v").alias("qv"))
    for n, least in ((300, 2), (10, 1)):
        found = knn._blas(q.where(F.col("query_id") < n), v, 1, "cosine", False)
        tasks = found.groupBy(F.spark_partition_id()).count().count()
        assert tasks >= least and (n > 10 or tasks == 1)


def test_generation(spark):
    for bad in ({"temperature": 3, "model": "m"}, {"max_tokens": 0, "model": "m"}, {"model": " "}):
        with pytest.raises(ValueError):
            generation.validate_generation_config(bad)
    needs = {"small": 4, "large": 16, "middle": 8}
    assert [generation.recommend_model(g, needs) for g in (64, 9, 1)] == ["large", "middle", "small"] and generation.recommend_model(8, {}) is None
    client = generation.HttpClient("http://127.0.0.1:9", timeout=1)
    assert not client.is_available()
    with pytest.raises(ConnectionError):
        client.generate("x")
    rows = spark.createDataFrame([(0, "a"), (1, "")], "id long, prompt string")
    got = generation.generate_rows(rows, lambda: type("C", (), {"generate": staticmethod(lambda p: p.upper() if p else 1 / 0)})).orderBy("id").collect()
    assert got[0]["answer"] == "A" and "ZeroDivision" in got[1]["error"]


def test_http_service(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    names = ["m"]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            self.send_response(200), self.end_headers()
            self.wfile.write(json.dumps({"models": [{"name": n, "size": 3} for n in names]}).encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200), self.end_headers()
            if self.path == "/api/pull":
                names.append(body["name"]) if body["name"] != "none" else None
                self.wfile.write(json.dumps({"status": "success"} if body["name"] != "none" else {"error": "unknown"}).encode())
                return
            parts = [{"response": "a"}, {"response": "b", "done": True}] if body["stream"] else [{"response": body["prompt"] + "!"}]
            self.wfile.write("\n".join(map(json.dumps, parts)).encode())

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = generation.HttpClient(f"http://127.0.0.1:{server.server_port}", "m")
    assert client.is_available() and client.model_info("m").size == 3 and client.model_info("x") is None
    assert client.ensure_model() and client.ensure_model("new") and names == ["m", "new"] and not client.ensure_model("none")
    assert client.generate("hi") == "hi!" and list(client.stream("hi")) == ["a", "b"]
    server.shutdown()


def test_retriever(spark):
    nodes = spark.createDataFrame([(0, "red apple"), (1, "green pear"), (2, "red pear")], "node_id long, text string")
    e = embed.HashEmbedder(32)
    r = retrieval.create_retriever(e, e.embed(nodes), nodes)
    q = spark.createDataFrame([(0, "red apple"), (1, " ")], "query_id long, query string")
    got = r.query(q, 2).orderBy("rank").collect()
    assert got[0]["node_id"] == 0 and got[0]["text"] == "red apple" and len(got) == 2
    assert '"num_results":0' in r.query_to_json(q, 2).where("query_id = 1").first()["json"]
    assert r.query(q, 3, 0.99).count() == 1


def test_generators(spark):
    a, b = (synthetic.random_vectors(spark, 50, 8, seed=3).repartition(n).orderBy("node_id").collect() for n in (1, 4))
    assert a == b and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in a)
    v = synthetic.random_vectors(spark, 50, 8, seed=0)
    q = synthetic.queries(spark, 20, 8, seed=0, dataset=v)
    assert q.join(v.withColumnRenamed("embedding", "e"), F.col("embedding") == F.col("e")).count() == 20
