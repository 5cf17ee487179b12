"""Command line: ``python -m gridspark.cli BOOK [SHEET] [--format dict|json|markdown] [--include ...]``."""

from __future__ import annotations

import argparse
import pprint

from .plans import render
from .sources.package import workbooks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridspark")
    p.add_argument("path")
    p.add_argument("sheet", nargs="?")
    p.add_argument("--format", choices=("dict", "json", "markdown"), default="dict")
    p.add_argument("--include", default="formulas,values,pivots", help="of " + ",".join(render.SECTIONS))
    a = p.parse_args(argv)
    include = tuple(x.strip().lower() for x in a.include.split(",") if x.strip())
    if unknown := set(include) - set(render.SECTIONS):
        p.error(f"unknown sections: {', '.join(sorted(unknown))}")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("gridspark").config("spark.ui.enabled", "false").getOrCreate()
    data = render.collect(workbooks(spark, a.path, "*"), include, a.sheet)
    if a.format == "json":
        print(render.as_json(data))
    elif a.format == "markdown":
        print(render.as_markdown(data))
    else:
        pprint.pprint(data)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
