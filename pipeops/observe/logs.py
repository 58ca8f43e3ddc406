"""Finding the pipeline node a log line speaks of."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the file whose lines are mapped.
GENERATED = "transformations/generated.py"


def attribute_log_lines(
    lines: DataFrame,
    source_map: DataFrame,
    text: str = "text",
    file: str = GENERATED,
) -> DataFrame:
    """Add ``generated_line, node_id, start_line, end_line`` to log lines.

    The line number stands in ``generated.py", line 14`` or ``generated.py:14``. Of
    the source-map ranges ``(node_id, file, start_line, end_line)`` around it the
    narrowest wins, then the one that starts first, then the first by node. Lines
    without a number or range get nulls.

    The ranges, a few per line of code, are settled to one node per code line, so
    that log lines meet them on equality instead of in a range join.
    """
    name = re.escape(file.rsplit("/", 1)[-1])
    quoted = F.regexp_extract(F.col(text), rf"""{name}["']?, line (\d+)""", 1)
    colon = F.regexp_extract(F.col(text), rf"{name}:(\d+)", 1)
    number = F.when(quoted != "", quoted).when(colon != "", colon).try_cast("int")

    ranges = source_map.where((F.col("file") == file) & (F.col("start_line") <= F.col("end_line")))
    width = F.col("end_line") - F.col("start_line")
    nodes = (
        ranges.select(
            F.explode(F.sequence("start_line", "end_line")).alias("generated_line"),
            F.struct(
                width.alias("width"), F.col("start_line"), F.col("node_id"), F.col("end_line")
            ).alias("r"),
        )
        .groupBy("generated_line")
        .agg(F.min("r").alias("r"))
        .select("generated_line", "r.node_id", "r.start_line", "r.end_line")
    )
    return lines.withColumn("generated_line", number).join(nodes, "generated_line", "left")
