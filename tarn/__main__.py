"""python -m tarn submit|lr|pagerank|stream: runs one job and prints its end state."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from tarn import jobs, session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tarn")
    sub = parser.add_subparsers(dest="command", required=True)
    submit = sub.add_parser("submit")
    submit.add_argument("--sql")
    submit.add_argument("--map-sql")
    submit.add_argument("--reduce-sql")
    submit.add_argument("--spec", help="a file with mapSql, reduceSql or sql, inputFiles, outputDir, numPartitions")
    submit.add_argument("--input", action="append", default=[])
    submit.add_argument("--output")
    submit.add_argument("--partitions", type=int, default=8)
    for name in ("lr", "pagerank"):
        one = sub.add_parser(name)
        one.add_argument("--input", required=True)
        one.add_argument("--output", required=True)
        one.add_argument("--iterations", type=int, default=2)
    stream = sub.add_parser("stream", help="takes the files that are there now, and what a checkpoint says is left of them")
    for name in ("input", "checkpoint", "map-sql", "reduce-sql", "output"):
        stream.add_argument(f"--{name}", required=True)
    stream.add_argument("--pattern", default="*.csv")
    stream.add_argument("--broadcast", action="append", default=[], help="name=path of a table that the statements join")
    stream.add_argument("--partitions", type=int, default=8)
    args = parser.parse_args(argv)
    engine = jobs.Engine(session.build())
    if args.command == "submit":
        spec = jobs.load_spec(args.spec) if args.spec else {}
        job = engine.submit(
            args.sql or spec.get("sql"), args.map_sql or spec.get("mapSql"), args.reduce_sql or spec.get("reduceSql"), args.input or spec.get("inputFiles"),
            spec.get("numPartitions") or args.partitions, args.output or spec.get("outputDir"),
        )
    elif args.command == "stream":
        tables = dict(b.split("=", 1) for b in args.broadcast)
        job = engine.submit_streaming(args.input, args.checkpoint, args.map_sql, args.reduce_sql, args.output, args.partitions, broadcasts=tables, pattern=args.pattern, every=None)
    else:
        job = (engine.submit_lr if args.command == "lr" else engine.submit_pagerank)(args.input, args.output, args.iterations)
    print(json.dumps(asdict(engine.wait(job))))
    return int(engine.status(job).state != jobs.COMPLETED)


if __name__ == "__main__":
    sys.exit(main())
