"""Places of rows within keys of any size.

A window function sorts a key's rows in one task.  Keys of more than MOST rows are therefore sorted by
key and order together, over range partitions; a row's place is then its place in its partition
plus the key's rows in the partitions before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import stages

#: Rows of a key that one task sorts.
MOST = 1 << 20


def numbered(rows: DataFrame, key: list[str], order: list[Column], name: str, most: int = MOST) -> DataFrame:
    """rows with name: 1, 2, ... within each key, in order.  The order must tell rows apart, or equal ones are
    numbered in any way."""
    plain = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    big = rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).drop("__n")
    big = stages.write(big)
    if big.isEmpty():
        return rows.withColumn(name, plain)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    few = rows.join(big, same(rows, big), "left_anti").withColumn(name, plain)
    large = rows.join(big, same(rows, big), "left_semi")
    return few.unionByName(_by_ranges(large, key, order, name).select(*few.columns))


def _by_ranges(rows: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    keys = [F.col(k) for k in key]
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("__place", T.LongType())])

    def count(batches):
        last, at = None, 0
        for batch in batches:
            place = []
            for now in zip(*(batch.column(k).to_pylist() for k in key)):
                at = at + 1 if now == last else 1
                last = now
                place.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "__place"])

    # written, as another sampling of the ranges would give other partitions
    placed = stages.write(sorted_.mapInArrow(count, schema).withColumn("__part", F.spark_partition_id()))
    parts = placed.groupBy(*key, "__part").agg(F.max("__place").alias("n"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(key)], F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    on = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(key)] + [F.col("__part") == F.col("__p")]
    # one row for each partition and one for each large key, of which there are few
    out = placed.join(F.broadcast(parts), on)
    return out.withColumn(name, (F.col("before") + F.col("__place")).cast("int")).select(*rows.columns, name)
