"""Prepare one source from the command line.

    python -m tablewright sales.csv --type csv --dataset sales --steps steps.json \
        --state /shared/state --output /shared/out --key transaction_id

``steps.json`` lists the transforms: ``[{"name": ..., "columns": [...], "params": {...}}, ...]``.
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from tablewright.operators.transforms import Step
from tablewright.plans.preparation import Preparation, prepare
from tablewright.session import build_session
from tablewright.sources.open import SOURCE_TYPES, open_source


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tablewright")
    parser.add_argument("source")
    parser.add_argument("--type", choices=SOURCE_TYPES, default="csv")
    parser.add_argument("--dataset", required=True)
    parser.add_argument("--steps", help="JSON file with the list of transforms")
    parser.add_argument("--goal", default="")
    parser.add_argument("--domain")
    parser.add_argument("--key", action="append", default=[])
    parser.add_argument("--watermark", help="process only rows after the last run's value of this column")
    parser.add_argument("--lookback", help="also read rows so far before that value, and rows without one, whose row key is new")
    parser.add_argument("--row-key", action="append", default=[], help="source column of the row key; --key if not given")
    parser.add_argument("--drift", choices=("fail", "warn", "accept"), default="fail")
    parser.add_argument("--allow-missing", action="store_true", help="run without transforms that the domain requires")
    parser.add_argument("--only-after", action="store_true", help="leave out rows that tie with the last watermark or have none")
    parser.add_argument("--force", action="store_true", help="run even if an equal run has succeeded")
    parser.add_argument("--state", required=True)
    parser.add_argument("--output", required=True)
    args = parser.parse_args(argv)
    steps = []
    if args.steps:
        with open(args.steps, encoding="utf-8") as f:
            steps = [Step(s["name"], tuple(s["columns"]) if s.get("columns") else None, s.get("params", {}))
                     for s in json.load(f)]
    spark = build_session()
    job = Preparation(steps, args.goal, args.domain, args.key, args.watermark, args.drift, force=args.force,
                      enforce_required=not args.allow_missing, lookback=False if args.only_after else args.lookback, row_key=args.row_key)
    result = prepare(open_source(spark, args.source, args.type), args.source, args.type, args.dataset, job,
                     args.state, args.output)
    print(json.dumps(dataclasses.asdict(result)))
    return 0 if result.status in ("success", "nothing_new") else 1


if __name__ == "__main__":
    raise SystemExit(main())
