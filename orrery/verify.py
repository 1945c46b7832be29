"""python -m orrery.verify EFFECTS RESULT [TOLERANCE]: whether a pooled result (JSON) is what its table of effects (Parquet, or TSV
with a header) gives. Exit 0 if so, 1 if not, 2 if a file is missing or faulty."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from .operators.gates import GateError, verify_pooled
from .sources.results import ResultError, read_json


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        claimed = read_json(args[1])
        rows = spark.read.csv(args[0], sep="\t", header=True) if args[0].endswith((".tsv", ".tsv.gz")) else spark.read.parquet(args[0])
        verify_pooled(rows, claimed, float(args[2]) if len(args) > 2 else 1e-8)
    except GateError as e:
        print(f"not reproduced: {e}", file=sys.stderr)
        return 1
    except (OSError, ValueError, ResultError, AnalysisException) as e:
        print(f"cannot be read: {e}", file=sys.stderr)
        return 2
    print("reproduced")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
