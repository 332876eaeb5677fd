"""Formats by name and by file extension; conversion between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.model import Graph, UnsupportedFormat
from strandloom.plans.runtime import ready
from strandloom.sources import fastg, gbz, gfa, odgi, vg


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    description: str
    read: Callable[[SparkSession, str], Graph]
    write: Callable[[Graph, str], None]


FORMATS = {
    f.name: f
    for f in (
        Format("gfa", ("gfa",), "Graphical Fragment Assembly 1.0 and 1.1", gfa.read_gfa, gfa.write_gfa),
        Format("vg", ("vg",), "VG protobuf stream", vg.read_vg, vg.write_vg),
        Format("fastg", ("fastg",), "FASTG of the SPAdes dialect", fastg.read_fastg, fastg.write_fastg),
        Format("gbz", ("gbz",), "GBZ: bidirectional GBWT of the paths with sequences", gbz.read_gbz, gbz.write_gbz),
        Format("odgi", ("og", "odgi"), "ODGI binary graph", odgi.read_odgi, odgi.write_odgi),
    )
}


def format_of(path: str | None = None, name: str | None = None) -> Format:
    """By name, else by extension; case does not matter."""
    if name is not None:
        for f in FORMATS.values():
            if name.lower() in (f.name, *f.extensions):
                return f
        raise UnsupportedFormat(f"unknown format '{name}'")
    ext = (path or "").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    for f in FORMATS.values():
        if ext in f.extensions:
            return f
    raise UnsupportedFormat(f"no format for '{path}'")


def formats_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, ",".join(f.extensions), f.description) for f in FORMATS.values()], "name string, extensions string, description string")


def load_graph(spark: SparkSession, path: str, format: str | None = None) -> Graph:
    return format_of(path, format).read(ready(spark), path)


def save_graph(g: Graph, path: str, format: str | None = None) -> None:
    format_of(path, format).write(g, path)


def convert(spark: SparkSession, source: str, target: str, from_format: str | None = None, to_format: str | None = None) -> None:
    """The output's format is settled before anything is read."""
    out = format_of(target, to_format)
    out.write(load_graph(spark, source, from_format), target)
