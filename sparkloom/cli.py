"""Command line: build a snapshot of a tree, query it, check its health, compare two."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from sparkloom.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)
    generate = sub.add_parser("generate", help="scan a tree and write a snapshot")
    generate.add_argument("root")
    generate.add_argument("output")
    generate.add_argument("--config")
    generate.add_argument("--framework", action="append", default=[])
    query = sub.add_parser("query", help="look something up")
    query.add_argument("snapshot")
    query.add_argument("what", choices=["name", "search", "callers", "calls", "explore", "dependencies", "module", "overview"])
    query.add_argument("argument", nargs="?", default="")
    analyze = sub.add_parser("analyze", help="dead code, duplicates, cycles, hotspots, coupling, advice")
    analyze.add_argument("snapshot")
    analyze.add_argument("what", choices=["dead-code", "duplicates", "circular", "hotspots", "coupling", "cohesion", "recommendations"])
    health = sub.add_parser("health", help="exit 1 below a score")
    health.add_argument("snapshot")
    health.add_argument("--threshold", type=int, default=70)
    diff = sub.add_parser("diff", help="what changed between two snapshots")
    diff.add_argument("older")
    diff.add_argument("newer")
    for s in (query, analyze, diff):
        s.add_argument("--json", action="store_true")
        s.add_argument("--limit", type=int, default=50)
    return p


def show(rows: DataFrame, as_json: bool, limit: int) -> None:
    if as_json:
        for line in rows.limit(limit).toJSON().toLocalIterator():
            print(line)
    else:
        rows.show(limit, truncate=False)


def main(arguments: list[str] | None = None) -> int:
    from sparkloom.operators import quality
    from sparkloom.snapshot import Snapshot
    from sparkloom.sources.files import load_config

    a = parser().parse_args(arguments)
    spark = local_session(a.cores)
    if a.command == "generate":
        Snapshot.build(spark, a.root, load_config(a.config, force_frameworks=a.framework or None)).write(a.output)
        return 0
    if a.command == "diff":
        show(Snapshot.read(spark, a.newer).diff(Snapshot.read(spark, a.older)), a.json, a.limit)
        return 0
    s = Snapshot.read(spark, a.snapshot)
    if a.command == "health":
        row = quality.gate(s.health(), a.threshold).first()
        print(row["reason"])
        return 0 if row["passed"] else 1
    if a.command == "query":
        found = {"name": s.query, "search": s.search, "callers": s.callers, "calls": s.calls, "explore": s.explore, "dependencies": s.dependencies, "module": s.module}
        show(s.overview() if a.what == "overview" else found[a.what](a.argument), a.json, a.limit)
        return 0
    ways = {"dead-code": s.dead_code, "duplicates": s.duplicates, "circular": lambda: s.cycles()[1], "hotspots": s.hotspots, "coupling": s.coupling, "cohesion": s.cohesion, "recommendations": s.recommendations}
    show(ways[a.what](), a.json, a.limit)
    return 0


if __name__ == "__main__":
    sys.exit(main())
