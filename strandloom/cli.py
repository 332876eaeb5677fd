"""Command line: convert, dbg, info, stats, formats.

``-`` reads standard input or writes standard output; the bytes go through a spool file in the shared folder,
and the format must be named. Exit codes: 0 done (a closed pipe included), 1 failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys
import uuid

from strandloom.operators.model import Graph, GraphError

log = logging.getLogger("strandloom")


def _session(threads: int | None):
    from pyspark.sql import SparkSession

    from strandloom.plans.runtime import ready

    builder = SparkSession.builder.appName("strandloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if threads or not os.environ.get("MASTER"):
        builder = builder.master(f"local[{threads or '*'}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)


def _spool(spark) -> str:
    from strandloom.plans.runtime import shared_dir

    return f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"


def _load(spark, path: str, name: str | None) -> Graph:
    from strandloom.sources.binary import write_bytes
    from strandloom.sources.registry import load_graph

    if path != "-":
        return load_graph(spark, path, name)
    spool = _spool(spark)
    write_bytes(spark, spool, iter(lambda: sys.stdin.buffer.read(1 << 20), b""))
    return load_graph(spark, spool, name)


def _emit(spark, path: str, write) -> None:
    """``write(path)``, or to a spool file that is then copied to standard output."""
    if path != "-":
        write(path)
        return
    spool = _spool(spark)
    write(spool)
    local = spool.removeprefix("file://")
    if os.path.exists(local):
        with open(local, "rb") as f:
            shutil.copyfileobj(f, sys.stdout.buffer)
    else:
        for row in spark.read.format("binaryFile").load(spool).select("content").toLocalIterator():
            sys.stdout.buffer.write(bytes(row["content"]))
    sys.stdout.buffer.flush()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description="Bidirected sequence graphs on Spark.")
    p.add_argument("--threads", type=int, help="local threads (default: all)")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="convert a graph to another format")
    c.add_argument("input")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--from", dest="source")
    c.add_argument("--to", dest="target")
    d = sub.add_parser("dbg", help="build a de Bruijn graph")
    d.add_argument("input")
    d.add_argument("-o", "--output", required=True)
    d.add_argument("-k", type=int, default=31)
    mode = d.add_mutually_exclusive_group()
    mode.add_argument("-c", "--colored", action="store_true", help="keep the paths")
    mode.add_argument("-t", "--topology", action="store_true", help="all walks instead of the paths")
    d.add_argument("-u", "--unitigs", action="store_true", help="compact unbranched chains")
    d.add_argument("--from", dest="source")
    d.add_argument("--to", dest="target", choices=["gfa", "fasta"])
    for name, text in (("info", "counts"), ("stats", "statistics")):
        s = sub.add_parser(name, help=text)
        s.add_argument("input")
        s.add_argument("--from", dest="source")
    sub.add_parser("formats", help="list the formats")
    return p


def _grouped(n: int | float) -> str:
    return f"{n:,}" if isinstance(n, int) else f"{n:,.2f}"


def render_stats(row: dict) -> list[str]:
    """Lines of one row of all statistics; degrees of ten and more share a line."""
    out = [f"{k.replace('_', ' ')}: {_grouped(v)}" for k, v in row.items() if k != "degree_histogram"]
    hist: dict[str, int] = {}
    for degree, n in row["degree_histogram"]:
        key = str(degree) if degree < 10 else "10+"
        hist[key] = hist.get(key, 0) + n
    return out + [f"degree {d}: {_grouped(n)}" for d, n in hist.items()]


def _dbg_target(args) -> str:
    ext = args.output.rpartition(".")[2].lower()
    target = args.target or ("fasta" if ext in ("fa", "fasta") else "gfa" if ext == "gfa" else None)
    if target is None:
        raise SystemExit2("the output format is neither gfa nor fasta; name it with --to")
    if target == "fasta" and (args.colored or not args.unitigs):
        raise SystemExit2("FASTA holds uncolored unitigs only")
    return target


class SystemExit2(Exception):
    """Wrong usage."""


def run(args) -> None:
    from strandloom.operators import colored, dbg, stats, unitigs
    from strandloom.sources import fastg, gfa
    from strandloom.sources.registry import FORMATS, format_of

    if args.command == "formats":
        for f in FORMATS.values():
            print(f"{f.name}\t{','.join(f.extensions)}\t{f.description}")
        return
    if args.command == "convert":
        if "-" in (args.input, args.output) and ((args.input == "-" and not args.source) or (args.output == "-" and not args.target)):
            raise SystemExit2("standard input and output need a named format")
        target = format_of(args.output, args.target)
        spark = _session(args.threads)
        graph = _load(spark, args.input, args.source)
        _emit(spark, args.output, lambda p: target.write(graph, p))
        return
    if args.command == "dbg":
        target = _dbg_target(args)
        from strandloom.functions.seq import check_k

        check_k(args.k)
        spark = _session(args.threads)
        graph = _load(spark, args.input, args.source)
        if args.colored:
            c = colored.color(graph, args.k)
            out = colored.compact_colored(c)[1] if args.unitigs else c.graph()
        else:
            d = (dbg.from_topology if args.topology else dbg.from_paths)(graph, args.k)
            if target == "fasta":
                u = unitigs.compact(d)
                _emit(spark, args.output, lambda p: fastg.write_fasta(u.unitigs, p))
                return
            out = unitigs.compact(d).graph() if args.unitigs else d.graph()
        _emit(spark, args.output, lambda p: gfa.write_gfa(out, p))
        return
    spark = _session(args.threads)
    graph = _load(spark, args.input, args.source)
    if args.command == "info":
        row = graph.counts().first().asDict()
        print("\n".join(f"{k.replace('_', ' ')}: {_grouped(v) if not isinstance(v, bool) else v}" for k, v in row.items()))
    else:
        print("\n".join(render_stats(stats.graph_stats(graph).first().asDict())))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.ERROR if args.quiet else [logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)])
    try:
        run(args)
    except BrokenPipeError:
        sys.stderr.close()
        return 0
    except SystemExit2 as e:
        log.error("%s", e)
        return 2
    except (GraphError, ValueError, OSError) as e:
        log.error("%s", e)
        return 1
    return 0
