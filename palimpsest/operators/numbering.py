"""Dense numbers over tables that no single task could sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written


def numbered(rows: DataFrame, *order: str, first: int = 0, number: str = "number") -> DataFrame:
    """Adds a number, from `first` on without gaps, in the order of some columns; rows that are equal in these get any order.
    Other than row_number() over everything, no task sees all rows: ranges of the order are sorted, each by a task, and
    written with the places of their rows; a range's numbers start behind the counts of those before it, one for each
    task. The places are those in the written table, so that reading it twice gives every row the same number."""
    place = "_place"
    while place in rows.columns:
        place += "_"
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    held = written(ranges, "numbered")
    part = F.shiftright(place, 33).cast("int")
    before, start = {}, first
    for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before[r.part], start = start, start + r.n
    if not before:
        return held.drop(place).withColumn(number, F.lit(first).cast("bigint"))
    starts = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), part)
    return held.withColumn(number, (starts + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop(place)
