"""python -m weftgraph: prints the version, or describes a snapshot."""

from __future__ import annotations

import argparse

from weftgraph import VERSION


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftgraph")
    parser.add_argument("--version", action="version", version=VERSION)
    parser.add_argument("snapshot", nargs="?", help="a snapshot folder to describe")
    options = parser.parse_args(arguments)
    if options.snapshot is None:
        print(f"weftgraph {VERSION}")
        return
    from pyspark.sql import SparkSession

    from weftgraph.sources import snapshot

    print(snapshot.manifest(SparkSession.builder.getOrCreate(), options.snapshot))


if __name__ == "__main__":
    main()
