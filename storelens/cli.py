"""Run a report by name, as the dashboard's HTTP routes did, without a server.

    python -m storelens.cli list
    python -m storelens.cli run top_stores --tables /data/shop --param years=2020,2021,2022 \\
        --out /data/reports/top_stores --format json
    python -m storelens.cli run rfm_segments --tables /data/shop --param year=2022 --param store=7 --show 20

``--tables`` is a folder with ``stores customers orders orderitems products``
(any Spark file format, ``--tables-format``); ``--tpch`` reads the TPC-H
style test tables instead. Parameters are the report function's keyword
arguments, converted by their annotation; a store key by its column's type.
Under spark-submit the session is the cluster's.
"""

from __future__ import annotations

import argparse
import inspect
import sys

from pyspark.sql import SparkSession
from pyspark.sql.types import StringType

from storelens.plans import customers, products, sales, stores

MODULES = (sales, stores, products, customers)
# Reports by name: every public function of the report modules that takes the
# table bundle first and returns a DataFrame.
REPORTS = {name: fn for m in MODULES for name, fn in vars(m).items()
           if inspect.isfunction(fn) and fn.__module__ == m.__name__ and not name.startswith("_")
           and list(inspect.signature(fn).parameters)[:1] == ["t"]
           and inspect.signature(fn).return_annotation in ("DataFrame", "pyspark.sql.DataFrame")}


def _typed(kind: str, text: str):
    """``text`` as the type that a parameter's annotation names."""
    optional, kind = "None" in kind, kind.replace("| None", "").strip()
    if optional and text.lower() == "none":
        return None
    if kind.startswith("Sequence[int]"):
        return [int(x) for x in text.split(",") if x]
    if kind == "int":
        return int(text)
    if kind == "bool":
        if text.lower() not in ("true", "false"):
            raise ValueError(f"true or false, not {text!r}")
        return text.lower() == "true"
    return text


def parse_params(pairs) -> dict[str, str]:
    """``key=value`` pairs as text; :func:`build` converts them."""
    return {key: raw for key, _, raw in (pair.partition("=") for pair in pairs or [])}


def _convert(fn, t, params: dict) -> dict:
    """Text values by the parameter's annotation; a store by the type of ``stores.storeid``."""
    out = {}
    for key, value in params.items():
        if not isinstance(value, str):
            out[key] = value
            continue
        try:
            if key == "store":
                keys = t.stores.schema["storeid"].dataType
                out[key] = value if isinstance(keys, StringType) else int(value)
            else:
                out[key] = _typed(str(inspect.signature(fn).parameters[key].annotation), value)
        except ValueError as exc:
            raise SystemExit(f"--param {key}={value}: {exc}") from None
    return out


def build(name: str, t, params: dict):
    """The report ``name`` on bundle ``t`` with keyword ``params``."""
    if name not in REPORTS:
        raise SystemExit(f"unknown report {name!r}; see `list`")
    fn = REPORTS[name]
    allowed = set(inspect.signature(fn).parameters) - {"t"}
    unknown = set(params) - allowed
    if unknown:
        raise SystemExit(f"{name} takes {sorted(allowed)}, not {sorted(unknown)}")
    return fn(t, **_convert(fn, t, params))


def main(argv=None, spark=None) -> int:
    ap = argparse.ArgumentParser(prog="storelens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="report names and parameters")
    run = sub.add_parser("run", help="run one report")
    run.add_argument("name")
    src = run.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder of the five tables")
    src.add_argument("--tpch", help="folder of TPC-H style test tables")
    run.add_argument("--tables-format", default="parquet")
    run.add_argument("--param", action="append", help="key=value (comma list for lists)")
    run.add_argument("--out", help="write the result here")
    run.add_argument("--format", default="parquet", help="output format (parquet, json, csv …)")
    run.add_argument("--show", type=int, default=0, help="print the first N rows")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        for name, fn in sorted(REPORTS.items()):
            params = [p for p in inspect.signature(fn).parameters if p != "t"]
            print(f"{name}({', '.join(params)})")
        return 0

    from storelens.sources import read_tables, tables_from_tpch, write_report

    if spark is None:
        spark = SparkSession.builder.appName("storelens").getOrCreate()  # master and settings from spark-submit
    t = (tables_from_tpch(spark, args.tpch) if args.tpch
         else read_tables(spark, args.tables, fmt=args.tables_format))
    df = build(args.name, t, parse_params(args.param))
    if args.out:
        write_report(df, args.out, fmt=args.format)
    if args.show:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
