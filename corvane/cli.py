"""Command line: preview, embed-demo, index, search, list, info, delete, benchmark, generate, chat."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .collection import collection_metadata, create_collection, delete_collection, list_collections, load_collection, search_export
from .operators import chunking, evaluate
from .operators.conversation import Conversation
from .operators.embed import HashEmbedder, embed_texts
from .operators.generation import HttpClient
from .operators.knn import embedding_statistics
from .sources import files, reports
from .sources.config import load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description="Document retrieval and vector search on Spark")
    p.add_argument("--config")
    p.add_argument("--root", default="data", help="folder of the stored tables")
    sub = p.add_subparsers(dest="command")

    def command(title: str, /, **arguments):
        c = sub.add_parser(title)
        for k, v in arguments.items():
            c.add_argument(k if v.pop("positional", False) else "--" + k.replace("_", "-"), **v)

    pos = {"positional": True}
    command("preview", file=dict(pos), chunks={"type": int, "default": 3}, length={"type": int, "default": 100})
    command("embed-demo", text={**pos, "nargs": "+"})
    command("index", name=dict(pos), path=dict(pos), algorithm={"choices": ["hnsw", "brute_force"], "default": "hnsw"}, formats={"default": "txt,markdown,pdf,docx"}, recursive={"action": "store_true"}, test_query={})
    command("search", name=dict(pos), query=dict(pos), top_k={"type": int, "default": 5}, min_score={"type": float, "default": 0.0}, ef_search={"type": int}, export={})
    command("list")
    command("info", name=dict(pos))
    command("delete", name=dict(pos))
    command("benchmark", n={"type": int, "default": 1000}, dimension={"type": int, "default": 384}, queries={"type": int, "default": 100}, k={"default": "1,5,10"}, ef={"default": "10,50,100"}, seed={"type": int, "default": 42}, export={})
    for c in ("generate", "chat"):
        command(c, name=dict(pos), **({"query": dict(pos)} if c == "generate" else {}), top_k={"type": int, "default": 5}, template={"default": "qa" if c == "generate" else "chat"}, model={})
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, client=None, ask=input) -> int:
    args = parser().parse_args(argv)
    out = out or sys.stdout
    say = lambda *x: print(*x, file=out)
    config = load_config(args.config)
    if args.command is None:
        say(f"{config['project']['name']} {config['project']['version']}: the settings are valid")
        return 0
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    root = args.root
    if args.command in ("search", "info", "delete", "generate", "chat") and collection_metadata(spark, root, args.name) is None:
        say(f"no collection named {args.name!r}")
        return 1
    ing = config["ingestion"]
    if args.command == "preview":
        docs = files.load_document(spark, args.file)
        for r in chunking.chunk_preview(chunking.chunk_documents(docs, ing["chunk_size"], ing["chunk_overlap"]), args.chunks, args.length).orderBy("index").collect():
            say(f"[{r['index']}] {r['chars']} characters: {r['preview']}")
    elif args.command == "embed-demo":
        rows = embed_texts(spark, HashEmbedder(config["embeddings"]["dimension"]), args.text)
        say(embedding_statistics(rows).first().asDict())
    elif args.command == "index":
        c = create_collection(spark, root, args.name, args.algorithm, metric=config["index"]["metric"], chunk_size=ing["chunk_size"], chunk_overlap=ing["chunk_overlap"])
        docs = files.scan_directory(spark, args.path, tuple(args.formats.split(",")), args.recursive)
        say(c.add_documents(docs.where("error is null")))
        for r in docs.where("error is not null").select("filepath", "error").collect():
            say(f"failed: {r['filepath']}: {r['error']}")
        if args.test_query:
            q = spark.createDataFrame([(0, args.test_query)], "query_id long, query string")
            for r in c.search(q, 3).orderBy("rank").collect():
                say(f"{r['rank']}. {r['score']:.3f} {r['chunk_id']}")
    elif args.command == "search":
        q = spark.createDataFrame([(0, args.query)], "query_id long, query string")
        found = load_collection(spark, root, args.name).search(q, args.top_k, args.min_score, args.ef_search)
        for r in found.orderBy("rank").collect():
            say(f"{r['rank']}. {r['score']:.3f} {r['chunk_id']}: {r['text'][:150]}")
        if args.export:
            search_export(args.query, args.name, found).write.mode("overwrite").text(args.export)
    elif args.command == "list":
        for r in list_collections(spark, root).collect():
            say(json.dumps(r.asDict()))
    elif args.command == "info":
        say(json.dumps(load_collection(spark, root, args.name).info()))
    elif args.command == "delete":
        delete_collection(spark, root, args.name)
        say(f"deleted {args.name}")
    elif args.command == "benchmark":
        ints = lambda s: [int(x) for x in s.split(",")]
        results = evaluate.run_benchmark(spark, evaluate.BenchmarkConfig(args.n, args.dimension, args.queries, ints(args.k), ints(args.ef), seed=args.seed))
        say(reports.console(results))
        if args.export:
            reports.to_json(results, args.export)
    else:
        g = config["generation"]
        client = client or HttpClient(g["base_url"], args.model or g["model"])
        c = load_collection(spark, root, args.name)
        talk = Conversation(g["max_turns"], g["max_history_tokens"])

        def one(question: str, history: str | None) -> str:
            a = c.answer(question, client, args.top_k, args.template, history)
            say(a["error"] or a["answer"])
            for s in a["sources"] or []:
                if s["cited"]:
                    say(f"  [{s['citation_num']}] {s['doc_id']} ({s['score']:.2f})")
            say(f"  {a['level']} confidence, {a['confidence']:.2f}")
            return a["answer"]

        if args.command == "generate":
            one(args.query, None)
        else:
            while (question := ask("> ").strip()) not in ("", "exit", "quit"):
                if question == "clear":
                    talk.clear()
                    continue
                talk.add_turn(question, one(question, talk.formatted()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
