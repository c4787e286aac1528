"""python -m millrace GROUP STAGE key=path ... [--option=value ...] [--config=FILE]; without arguments, or with a stage alone, prints help."""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from millrace.plans.stages import STAGES, run
    from millrace.sources.io import read_config

    name = " ".join(argv[:2])
    if len(argv) < 3 or name not in STAGES:
        print(__doc__)
        for k, (text, _) in STAGES.items():
            print(f"  {k}: {text}")
        return 0 if len(argv) < 3 else 2
    pairs = [a.partition("=")[::2] for a in argv[2:] if not a.startswith("--")]
    options = {k: int(v) if v.lstrip("-").isdigit() else v for k, v in (a[2:].partition("=")[::2] for a in argv[2:] if a.startswith("--"))}
    paths = {k: v.split(",") if "," in v else v for k, v in pairs}
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"millrace {name}").getOrCreate()
    if "config" in options:
        options = read_config(spark, options.pop("config")) | options
    run(name, spark, paths, options)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
