"""Commands: simulate, file, diagnose, evaluate. Returns 0, 1 for a failure and 130 when interrupted."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import COMMAND, Analysis, Band, Simulation
from .operators.kernels import ALGORITHMS
from .plans import analysis, diagnostic, reports
from .sources import recordings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulsegrid")
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (("simulate", "a simulated recording"), ("file", "a table of frames (session, i, t, r, g, b)"), ("diagnose", "a capture through the grid"), ("evaluate", "the accuracy battery")):
        c = commands.add_parser(name, help=text)
        c.add_argument("--algorithm", default="pos", choices=list(ALGORITHMS))
        c.add_argument("--window", type=float, default=COMMAND.window_s)
        c.add_argument("--step", type=float, default=1.0)
        c.add_argument("--bpm-min", type=float, default=45.0)
        c.add_argument("--bpm-max", type=float, default=200.0)
        c.add_argument("--fps", type=float, default=30.0)
        c.add_argument("--save", help="a folder for the estimates")
        if name in ("file", "diagnose"):
            c.add_argument("path")
        if name == "simulate":
            c.add_argument("--bpm", type=float, default=72.0)
            c.add_argument("--seconds", type=float, default=40.0)
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    config = Analysis(window_s=args.window, step_s=args.step, band=Band.of_bpm(args.bpm_min, args.bpm_max), algorithm=args.algorithm)
    if args.command == "evaluate":
        rates = spark.createDataFrame([(x,) for x in recordings.BATTERY_BPM], "bpm double")
        made = recordings.simulated(recordings.scenarios(rates)).withColumnRenamed("bpm", "truth")
        found = analysis.analysed(made, 30.0, Analysis(background=False), ["scenario", "truth"], "i", list(ALGORITHMS))
        errors = found.select("algorithm", F.abs(F.col("bpm") - F.col("truth")).alias("error"), "snr_db")
        return reports.markdown(reports.accuracy(errors, ["algorithm"]).orderBy("algorithm"))
    if args.command == "simulate":
        frames = spark.createDataFrame(recordings.simulate(Simulation(bpm=args.bpm, duration_s=args.seconds, fps=args.fps)).assign(session=0))
    else:
        frames = spark.read.parquet(args.path)
    if args.command == "diagnose":
        found = diagnostic.grid(frames if "variant" in frames.columns else frames.withColumn("variant", F.lit("all")), args.fps)
        return reports.markdown(reports.diagnostic_ranking(found, ["variant", "algorithm", "with_background"]))
    found = analysis.sessions(frames, args.fps, config)
    if args.save:
        reports.write_estimates(found.filter(F.col("error_code").isNull()), args.save)
    return reports.markdown(reports.session_report(found.filter(F.col("error_code").isNull())))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pulsegrid").getOrCreate()
    try:
        print(run(spark, args))
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
