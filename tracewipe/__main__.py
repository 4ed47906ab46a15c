"""``python -m tracewipe [options] PATH...``: clean files or folders; exit code 0, 1 (error) or 2 (not cleanable)."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import folder
from .operators import report
from .operators.model import Policy
from .operators.scrub import scrub
from .scratch import Rounds
from .sources import export, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewipe", description=__doc__)
    p.add_argument("paths", nargs="+")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--in-place", action="store_true")
    where.add_argument("--random-name", metavar="SEED", help="base32 names from a secret seed")
    where.add_argument("--suffix", default="clean")
    p.add_argument("--dry-run", action="store_true", help="report, write nothing")
    p.add_argument("--stop", action="store_true", help="end with the first file that cannot be written")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true", help="leave out files without findings")
    p.add_argument("--verify", action="store_true")
    p.add_argument("--sidecars", action="store_true", help="also clean files that belong to an input")
    p.add_argument("--keep-orientation", action="store_true")
    p.add_argument("--keep-profile", action="store_true")
    p.add_argument("--no-recurse", action="store_true", help="leave embedded images alone")
    p.add_argument("--limit", type=int, default=files.LIMIT, help="largest file in bytes")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    inputs = reduce(DataFrame.unionByName, [files.read_files(spark, p, args.limit) for p in args.paths])
    if args.sidecars:
        around = spark.read.format("binaryFile").load([r[0] for r in inputs.select(folder(F.col("path"))).distinct().collect()])
        beside = files.sidecars(inputs.select("path"), around.select("path")).select(F.col("sidecar").alias("path")).distinct()
        inputs = inputs.unionByName(around.filter(F.col("length") <= args.limit).join(beside, "path", "left_semi"))
    policy = Policy(args.keep_orientation, args.keep_profile, not args.no_recurse, args.limit)
    rounds = Rounds(spark, "scrubbed")
    done = rounds.saved(scrub(inputs, ["path"], policy, verify=args.verify))  # written once; reports and exports read from it
    shown = report.loud(done) if args.quiet else done
    line = report.as_json(F.col("path")) if args.json else F.concat("path", F.lit(": "), report.as_text())
    for r in shown.select("path", line.alias("line")).orderBy("path").toLocalIterator():
        print(r.line)
    failed = False
    if not args.dry_run:
        mode = "in_place" if args.in_place else "random" if args.random_name else "suffix"
        target = export.destination(F.col("path"), mode, args.suffix, seed=F.lit(args.random_name) if args.random_name else None)
        wrote = rounds.saved(export.export(done, target, replace=args.in_place, stop=args.stop))
        for r in wrote.toLocalIterator():
            print(f"wrote {r.path} ({r.bytes} bytes)" if r.error is None else f"{r.path}: {r.error}", file=sys.stderr)
            failed |= r.error is not None
    code = done.agg(F.max(report.exit_code())).first()[0] or 0
    rounds.close()
    late = [files.oversized(spark, p, args.limit).limit(1).count() for p in args.paths]
    return max(code, int(any(late)), int(failed))


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("tracewipe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
