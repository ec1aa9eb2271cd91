"""Command line: python -m sedgewren update|search|inspect|evaluate|threads ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from sedgewren.config import DEFAULT, read_settings
from sedgewren.functions.embedding import embedder_of
from sedgewren.operators import evaluate, index, lexical, segments
from sedgewren.operators.index import Index
from sedgewren.sources import tables
from sedgewren.streaming.refresh import update_directory


def _opened(spark: SparkSession, root: str) -> Index | None:
    return segments.load(spark, root) or (None if "segments" in (index.manifest(spark, root) or {}) else index.load(spark, root))


def _print(rows: DataFrame) -> None:
    """One JSON object a line; only reports of bounded size get here."""
    for line in rows.toJSON().toLocalIterator():
        print(line)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sedgewren", description="Retrieval over a directory of documents.")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, text: commands.add_parser(name, help=text)
    p = add("update", "bring an index to the files of a directory")
    p.add_argument("directory")
    p.add_argument("index")
    p.add_argument("--recursive", action="store_true")
    p = add("search", "the best chunks for a query, by BM25")
    p.add_argument("index")
    p.add_argument("query")
    p.add_argument("--top-k", type=int, default=DEFAULT.top_k)
    p = add("inspect", "what an index holds")
    p.add_argument("index")
    p.add_argument("--keyword")
    p = add("evaluate", "golden questions; the exit code is 0 if they pass, 1 if not, 2 without an index")
    p.add_argument("index")
    p.add_argument("questions")
    p.add_argument("--top-k", type=int, default=DEFAULT.top_k)
    p.add_argument("--min-recall", type=float, default=DEFAULT.min_recall)
    p = add("threads", "milliseconds that the encoder of a settings file takes, by number of threads")
    p.add_argument("settings")
    p.add_argument("texts", nargs="+")
    p.add_argument("--threads", type=int, nargs="+", default=[1, 2, 4, 8])
    return parser


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    if a.command == "threads":
        settings = read_settings(a.settings)
        times = evaluate.thread_sweep(lambda n: embedder_of(settings | {"embedding.threads": str(n)})[0](), a.texts, a.threads)
        print(json.dumps(times))
        return 0
    spark = SparkSession.builder.appName("sedgewren").getOrCreate()
    if a.command == "update":
        told = lambda done, total: print(f"{done} of {total} files", file=sys.stderr)
        print(json.dumps(asdict(update_directory(spark, a.directory, a.index, recursive=a.recursive, on_file=told))))
        return 0
    found = _opened(spark, a.index)
    if found is None:
        print("there is no index", file=sys.stderr)
        return 2
    if a.command == "evaluate":
        golden = tables.golden_set(spark, a.questions, a.top_k)
        result = evaluate.run(found, golden, replace(DEFAULT, top_k=a.top_k, min_recall=a.min_recall))
        for rows in (result.judged, result.verdict):
            if rows is not None:
                _print(rows)
        return result.code
    if a.command == "search":
        asked = spark.createDataFrame([(0, a.query)], "query_id long, query string")
        hits = lexical.bm25_topk(found, asked, replace(DEFAULT, top_k=a.top_k))
        _print(hits.join(found.chunks.select("chunk_id", "source", "text"), "chunk_id").orderBy("rank").select("rank", "score", "source", "text"))
    else:
        for name, rows in evaluate.inspect_index(found.chunks, a.keyword).items():
            print(f"# {name}")
            _print(rows)
    return 0


if __name__ == "__main__":
    sys.exit(main())
