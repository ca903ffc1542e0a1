"""The most frequent values of a column without shuffling all of its values.

Counters of a bounded number, one for each remainder of the values' hashes, bound every value's count from above. The values in
the heaviest of them are counted exactly; if the k-th of these counts exceeds every other counter no value elsewhere can
belong to the top. Otherwise the search widens to one counter per hash: numbers are shuffled, no values. Then only values whose
hash occurs often enough are counted, and where even single values belong to the top these are the least of all that
occur once, found by sorted limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from lakewright.functions.columns import col
from lakewright.session import drop_folder, new_path

COUNTERS = 1 << 16
# How many times k counters are looked into first, and how many times k of the least values are taken at once.
FIRST_LOOK, LEAST_AT_ONCE = 4, 16

_SCHEMA = "column string, value string, count bigint, rank int"


def top_values(df: DataFrame, column: str, k: int = 10, counters: int = COUNTERS) -> DataFrame:
    """The ``k`` most frequent non-null values of a column with their exact counts; ties by value."""
    values = df.select(col(column).cast("string").alias("value")).filter("value IS NOT NULL")
    found = _proven(values, k, counters)
    if found is None:
        found = _by_hash(values, k)
    rows = [(column, r["value"], r["count"], i) for i, r in enumerate(found, 1)]
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def _counted(values: DataFrame, k: int) -> list[Row]:
    """The top of the exact counts; a task sends its ``k`` best."""
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k).collect()


def _proven(values: DataFrame, k: int, counters: int) -> list[Row] | None:
    """The top from bounded counters, or None where they prove nothing."""
    place = F.pmod(F.xxhash64("value"), F.lit(counters))
    sums = values.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    looked = FIRST_LOOK * k
    heaviest = sums.orderBy(F.desc("n"), "place").limit(looked + 1).collect()
    rest = heaviest[looked].n if len(heaviest) > looked else 0
    if rest and heaviest[min(k, looked) - 1].n <= rest:
        return None  # the k-th count can't exceed the k-th counter
    found = _counted(values.filter(place.isin([r.place for r in heaviest[:looked]])), k)
    return found if not rest or (len(found) == k and found[-1]["count"] > rest) else None


def _by_hash(values: DataFrame, k: int) -> list[Row]:
    spark, path = values.sparkSession, new_path(values.sparkSession, "value-hashes")
    values.groupBy(F.xxhash64("value").alias("hash")).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    hashes = spark.read.parquet(path)
    best = hashes.orderBy(F.desc("n")).select("n").limit(k).collect()
    least = max(2, best[-1].n if len(best) == k else 2)
    hashed = values.withColumn("hash", F.xxhash64("value"))
    while True:
        found = _counted(hashed.join(hashes.filter(F.col("n") >= least), "hash", "left_semi"), k)
        # A value left out has a smaller count than its hash allows, so none can come before these.
        if least == 2 or (len(found) == k and found[-1]["count"] >= least):
            break
        least = max(2, found[-1]["count"]) if len(found) == k else 2
    found = [r for r in found if r["count"] > 1]
    if len(found) < k:
        found += _single(values, hashes, k - len(found))
    drop_folder(spark, path)
    return found


def _single(values: DataFrame, hashes: DataFrame, wanted: int) -> list[Row]:
    """The least values that occur once. A value of a hash that occurs more often is told apart by an exact count."""
    spark, out, last, rows = values.sparkSession, [], None, LEAST_AT_ONCE * wanted
    while len(out) < wanted:
        left = values if last is None else values.filter(F.col("value") > F.lit(last))
        taken = [r["value"] for r in left.orderBy("value").limit(rows).collect()]
        if not taken:
            break
        last = taken[-1]
        kinds = spark.createDataFrame([(v,) for v in dict.fromkeys(taken)], "value string")
        once = kinds.withColumn("hash", F.xxhash64("value")).join(hashes, "hash").filter("n = 1").orderBy("value").limit(wanted - len(out))
        shared = kinds.withColumn("hash", F.xxhash64("value")).join(hashes, "hash").filter("n > 1")
        exact = values.join(F.broadcast(shared.select("value")), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("count")).filter("count = 1")
        both = once.select("value").union(exact.select("value")).orderBy("value").limit(wanted - len(out)).collect()
        out += [Row(value=r["value"], count=1) for r in both]
        rows *= 2
    return out
