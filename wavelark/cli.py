"""python -m wavelark.cli --run NAME: paired events of a run, to CSV or Parquet. Exit code 1: failed, 2: wrong use."""

from __future__ import annotations

import argparse
import sys

from .plans.catalog import Context
from .plans.profiles import cpu_default
from .session import session
from .sinks import export


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wavelark")
    p.add_argument("--run", required=True)
    p.add_argument("--data-root", default="DAQ")
    p.add_argument("--adapter", default="vx2730")
    p.add_argument("--target", default="df_paired")
    p.add_argument("--output", help="path ending in .csv, .json or .parquet")
    p.add_argument("--store")
    p.add_argument("--plan", action="store_true", help="list the datasets and stop")
    a = p.parse_args(argv)
    ctx = Context(session(), {"data_root": a.data_root, "daq_adapter": a.adapter}, a.store)
    ctx.register(*cpu_default())
    try:
        if a.plan:
            print("\n".join(ctx.plan(a.target, a.run)))
            return 0
        df = ctx.get(a.run, a.target)
        print(export(df, a.output) if a.output else df.limit(20).toPandas().to_string())
        return 0
    except Exception as e:
        print(f"{a.target} of {a.run}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
