"""A prompt for queries: reads until a semicolon, prints rows and the time it took; ``exit`` ends it."""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from typing import TextIO

from pyspark.sql import SparkSession


def repl(engine, source: TextIO, out: TextIO, rows: int = 20) -> None:
    held = ""
    for line in source:
        if not held.strip() and line.strip().lower() in ("exit", "exit;", "quit"):
            return
        held += line
        if ";" not in line:
            continue
        began = time.time()
        try:
            found = engine.execute(held)
            shown = found.limit(rows + 1).toPandas()
            print(shown.head(rows).to_string(index=False), file=out)
            if len(shown) > rows:
                print(f"only the first {rows} rows are shown", file=out)
            print(f"{time.time() - began:.2f} s", file=out)
        except Exception as e:
            print(f"{type(e).__name__}: {e}", file=out)
        held = ""


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="SQL over columns that services fill")
    parser.add_argument("--config", required=True, help="a Python module; see oakmill.sources.factory")
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(args)
    from oakmill.sources.factory import from_config

    spark = SparkSession.builder.appName("oakmill").getOrCreate()
    repl(from_config(spark, importlib.import_module(given.config), given.verbose), sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
