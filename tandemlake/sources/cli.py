"""Rows of a lake from the command line: python -m tandemlake.sources.cli --tickers A,B --start 2024-01-01 --end 2024-06-30 --root ROOT [--out FILE]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from ..session import build_session
from . import lake


def words(text: str | None) -> list[str]:
    return (text or "").replace(",", " ").split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--tickers", required=True, help="by commas or blanks")
    p.add_argument("--start", required=True)
    p.add_argument("--end", required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--granularity", choices=("day", "minute"), default="day")
    p.add_argument("--manifest")
    p.add_argument("--no-fallback", action="store_true", help="no walk of the folders where the manifest names no file")
    p.add_argument("--columns", help="by commas or blanks; datetime and ticker are always there")
    p.add_argument("--source-timezone", default="UTC")
    p.add_argument("--to-timezone")
    p.add_argument("--out", help="a path that ends in .parquet, .csv, .txt, .feather or .ft")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = build_session("lake")
    df = lake.open_lake(
        spark, a.root, words(a.tickers), a.start, a.end, a.granularity, a.manifest, not a.no_fallback, columns=words(a.columns) or None, source_tz=a.source_timezone, to_tz=a.to_timezone
    )
    if a.out:
        lake.write(df.orderBy("ticker", "datetime"), a.out)
        print(f"wrote {a.out}")
    else:
        n, lo, hi = df.agg(F.count("*"), F.min("datetime"), F.max("datetime")).first()
        print(f"{n} rows from {lo} to {hi}; columns {', '.join(df.columns)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
