"""Command line: python -m marlspike [--db FOLDER] [--root FOLDER]... COMMAND"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .service import Engine, Settings
from .sources import scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlspike")
    p.add_argument("--db", default="./marlspike-db")
    p.add_argument("--root", action="append", default=[])
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--scope", action="append")
    sub.add_parser("ingest", help="files, and folders with all that can be read in them").add_argument("paths", nargs="+")
    n = sub.add_parser("read-neighbors")
    n.add_argument("chunk", type=int)
    n.add_argument("--path")
    n.add_argument("--source")
    n.add_argument("--before", type=int, default=2)
    n.add_argument("--after", type=int, default=2)
    sub.add_parser("list").add_argument("--scope", action="append")
    d = sub.add_parser("delete")
    d.add_argument("--path")
    d.add_argument("--source")
    sub.add_parser("status")
    sub.add_parser("sync").add_argument("path", nargs="?")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    settings = Settings.from_env(dict(os.environ))
    if a.root:
        settings.roots = a.root
    for warning in settings.warnings:
        print(warning, file=sys.stderr)
    engine = Engine(SparkSession.builder.appName("marlspike").getOrCreate(), a.db, settings)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    try:
        out = {
            "query": lambda: rows(engine.query_documents(a.text, a.limit, a.scope)),
            "ingest": lambda: engine.ingest_files(list(dict.fromkeys(f for p in a.paths for f in scan.files_of(os.path.abspath(p), settings.roots, [engine.db])))),
            "read-neighbors": lambda: engine.read_chunk_neighbors(a.chunk, a.path, a.source, a.before, a.after),
            "list": lambda: engine.base_dirs() | dict(zip(("files", "sources"), map(rows, engine.list_files(a.scope)))),
            "delete": lambda: engine.delete_file(a.path, a.source),
            "status": engine.status,
            "sync": lambda: engine.sync(a.path),
        }[a.command]()
    except (ValueError, RuntimeError) as e:
        print(str(e), file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False))
    return int(isinstance(out, dict) and bool(out.get("error")))


if __name__ == "__main__":
    sys.exit(main())
