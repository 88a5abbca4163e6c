"""The development samples: the first lines of an input, unchanged or re-serialised.

    python -m reviewlens.plans.sample --source META.json --target SAMPLE [--lines 1000]
    python -m reviewlens.plans.sample --source REVIEWS.json --target SAMPLE --reviews
"""

from __future__ import annotations

import argparse

from reviewlens.operators.sample import dev_sample
from reviewlens.schemas import REVIEW_SAMPLE_SCHEMA, SAMPLE_LINES
from reviewlens.session import build_session


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    ap.add_argument("--source", required=True)
    ap.add_argument("--target", required=True)
    ap.add_argument("--lines", type=int, default=SAMPLE_LINES)
    ap.add_argument("--reviews", action="store_true", help="re-serialise each line to the review fields")
    ap.add_argument("--master")
    args = ap.parse_args(argv)
    spark = build_session(args.master)
    options = {"clean": True, "schema": REVIEW_SAMPLE_SCHEMA, "defaults": {"unixReviewTime": 0}} if args.reviews else {}
    print(dev_sample(spark, args.source, args.target, n=args.lines, **options).count(), "lines")


if __name__ == "__main__":
    main()
