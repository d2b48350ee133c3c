"""Indexes a tree, keeps the index as the tree is, and answers searches from standard input: one a line, either plain
words or a JSON object with query, lang, limit, context and path; with --serve, messages of the tool protocol."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import tempfile

from pyspark.sql import SparkSession

from corvine.plans.embedders import HashingEmbedder, OnnxEmbedder
from corvine.plans.index import Index
from corvine.schema import Request
from corvine.server import request_of, serve
from corvine.sources.scan import read_files, walk
from corvine.streaming.updater import follow


def line_request(line: str) -> Request:
    line = line.rstrip("\n")
    return request_of(json.loads(line)) if line.lstrip().startswith("{") else Request(line)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvine", description=__doc__)
    parser.add_argument("--path", default=".", help="tree to index")
    parser.add_argument("--model-dir", help="directory of an embedding model (model_quantized.onnx, tokenizer.json); hashed vectors without")
    parser.add_argument("--no-embedding", action="store_true", help="keyword search only")
    parser.add_argument("--no-follow", action="store_true", help="index once and do not watch the tree")
    parser.add_argument("--serve", action="store_true", help="serve the search tool over standard input and output")
    parser.add_argument("--index", help="folder of the index; a temporary one without")
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    spark = SparkSession.builder.appName("corvine").getOrCreate()
    embedder = None
    if not args.no_embedding:
        embedder = OnnxEmbedder(args.model_dir) if args.model_dir else HashingEmbedder()
    root = args.index or "file://" + tempfile.mkdtemp(prefix="corvine-")
    index = Index(spark, root, embedder, postings=True)
    watcher = None
    if args.no_follow:
        index.build(read_files(spark, walk(args.path)))
    else:
        if not index.followed():  # the first batch is the whole tree
            index.clear()
        watcher = follow(spark, args.path, index, index.stream)
        watcher.processAllAvailable()
    logging.info("files %d, blocks %d", index.files().count(), index.blocks().count())
    search = lambda request: index.engine().render(request)  # noqa: E731  the newest committed state
    try:
        if args.serve:
            serve(search)
        else:
            for line in sys.stdin:
                try:
                    print(search(line_request(line)), flush=True)
                except ValueError as e:
                    print(f"error: {e}", flush=True)
    finally:
        if watcher is not None:
            watcher.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
