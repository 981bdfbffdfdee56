"""Command line: python -m scanloom PROGRAM ...; programs are those of plans.programs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import config
from .plans import programs


def main() -> None:
    parser = argparse.ArgumentParser(prog="scanloom")
    parser.add_argument("--preset", choices=("KITTI", "KITTI360", "FORD", "APOLLO"), default="KITTI")
    parser.add_argument("--config", help="a YAML file over the preset")
    sub = parser.add_subparsers(dest="program", required=True)
    arguments = {
        "score-pairs": ("pairs_file", "cloud_dir", "label_dir", "out"),
        "pose-pairs": ("pairs_file", "cloud_dir", "label_dir", "out"),
        "one-pair": ("scan_a", "scan_b", "cloud_dir", "label_dir"),
        "retrieve": ("cloud_dir", "label_dir", "out_raw", "out_verified"),
        "evaluate-scores": ("scores_file",),
        "evaluate-retrieval": ("candidates_file", "truth_file"),
        "evaluate-poses": ("truth_file", "poses_file"),
    }
    for name, names in arguments.items():
        own = sub.add_parser(name)
        for n in names:
            own.add_argument(n, type=int if n in ("scan_a", "scan_b") else str)
        if name == "evaluate-retrieval":
            own.add_argument("--one-percent", type=int, default=45, help="candidates that recall at one percent looks at")
            own.add_argument("--zero-is-none", dest="zero_counts", action="store_false", help="scan 0 alone is no true candidate")
        if name == "evaluate-poses":
            own.add_argument("--inverted", action="store_true", help="estimates map the other way round")
    asked = parser.parse_args()
    settings = getattr(config, asked.preset)
    if asked.config:
        settings = config.load(asked.config, settings)
    spark = SparkSession.builder.appName("scanloom").getOrCreate()
    values = [getattr(asked, n) for n in arguments[asked.program]]
    more = {n: getattr(asked, n) for n in ("one_percent", "zero_counts", "inverted") if hasattr(asked, n)}
    if not asked.program.startswith("evaluate"):
        more["config"] = settings
    found = getattr(programs, asked.program.replace("-", "_"))(spark, *values, **more)
    if asked.program == "one-pair":
        print("score:", found[0], "pose:", *found[1])
    else:
        found.show(truncate=False)


if __name__ == "__main__":
    main()
