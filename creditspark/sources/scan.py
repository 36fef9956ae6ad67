"""What a DataFrame reads, told from its logical plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def is_file_scan(df: DataFrame) -> bool:
    """Whether ``df`` is scans of files, joined by unions at most, with filters and
    row-wise columns only: such rows are the same, in the same partitions and
    places, each time."""
    plan = df._jdf.queryExecution().analyzed().toString()
    lines = [re.sub(r"^[\s:+|-]*", "", line) for line in plan.splitlines() if line.strip()]
    return all(re.match("Project|Filter|SubqueryAlias|Union|Relation", x) for x in lines)
