"""The command line: archives in, Parquet tables out.

Exit codes: 1 the output folder can't be written, 2 the output exists, 3 its name can't be used, 4 the input can't be processed, 100 no inputs.
"""

from __future__ import annotations

import datetime
import json
import os
import sys
import uuid

from archloom.config import Config, from_args
from archloom.operators.metadata import validate


def run(config: Config, spark=None) -> int:
    if not config.disable_metadata_checks:
        validate(config.title, config.description, config.long_description, [t for t in config.tags.split(";") if t], None)
    if not config.inputs:
        return 100
    if not os.path.isdir(config.output) or not os.access(config.output, os.W_OK):
        return 1
    name = (config.file_name or f"{config.name}_{{period}}").replace("{period}", datetime.date.today().strftime("%Y-%m"))
    at = os.path.join(config.output, name)
    if os.path.exists(at) and not config.overwrite:
        return 2
    try:
        probe = os.path.join(config.output, f"{name}.{uuid.uuid4().hex}")
        open(probe, "w").close()
        os.unlink(probe)
    except OSError:
        return 3
    from pyspark.sql import Observation, SparkSession
    from pyspark.sql import functions as F

    from archloom.plans.conversion import Unprocessable, convert

    spark = spark or SparkSession.builder.appName("archloom").getOrCreate()
    try:
        tables = convert(spark, config)
    except Unprocessable as e:
        print(e, file=sys.stderr)
        return 4
    seen = Observation("items")
    tables["items"] = tables["items"].observe(seen, F.count(F.lit(1)).alias("written"))
    for k, t in tables.items():
        t.write.mode("overwrite").parquet(f"{at}/{k}")
    if config.failed_items:
        spark.read.parquet(f"{at}/errors").write.mode("overwrite").parquet(config.failed_items)
    if config.progress_file:
        n = seen.get["written"]
        with open(config.progress_file, "w") as f:
            json.dump({"written": n, "total": n}, f)
    return 0


def main(args: list[str] | None = None) -> int:
    return run(from_args(sys.argv[1:] if args is None else args))


if __name__ == "__main__":
    sys.exit(main())
