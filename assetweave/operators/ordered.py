"""Order within large groups: running figures, ranks and percentiles by pieces of a group, not by a window over all of it.

A group's rows are cut into pieces at approximate quantiles of a number that never falls in the order. Rows of one value
that is a cut lie in a piece of their own, which is cut again by a second number. Windows run over pieces and over the
pieces' totals, so a group of any size, or of one value, is shared out over many tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES = 64


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; on one machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


#: What stored() has written, by session.
_written: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Deletes all that stored() has written in this application; for when no result that reads it is needed any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores if they come in fewer parts than there are, as those of a small file do."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, or ones like them that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _place(cuts: Column, x: Column) -> Column:
    """Twice the number of cuts under x, and one more if x is a cut."""
    return F.size(F.filter(cuts, lambda c: c < x)) + F.size(F.filter(cuts, lambda c: c <= x))


def in_pieces(rows: DataFrame, keys: list[str], first: Column, second: Column | None = None, pieces: int = PIECES) -> DataFrame:
    """rows with piece, an array of two numbers that never falls in the order within the keys.

    first and second: numbers that aren't null; the order goes by first and, where that is equal, by second.
    """
    at = [k / pieces for k in range(1, pieces)]
    kept = rows.columns
    one, two, place, found = free(rows, "first", "second", "place", "cuts")
    numbered = rows.withColumns({one: first.cast("double"), two: second.cast("double") if second is not None else F.lit(0.0)})
    cuts = lambda df, by, c: df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(c, F.array(*map(F.lit, at)), 16 * pieces)).alias(found))
    join = lambda df, small, by: df.join(small, by, "left") if by else df.join(F.broadcast(small))
    numbered = join(numbered, cuts(numbered, keys, one), keys).withColumn(place, _place(F.col(found), F.col(one))).drop(found)
    if second is None:
        return numbered.select(*kept, F.array(place, F.lit(0)).alias("piece"))
    # pieces of odd numbers hold one value
    again = cuts(numbered.where(F.col(place) % 2 == 1), [*keys, place], two)
    numbered = numbered.join(again, [*keys, place], "left")
    return numbered.select(*kept, F.array(place, F.coalesce(_place(F.col(found), F.col(two)), F.lit(0))).alias("piece"))


def numbered(rows: DataFrame, by: list[Column], name: str = "rank", pieces: int | None = None) -> DataFrame:
    """rows with their numbers, from 1, in the order of by, which had better tell all rows apart.

    The rows are dealt once by ranges of the whole of by, sorted and written with their places in their ranges; a range's
    number of rows then shifts those of the ranges after it. So the ranges are even whatever the columns hold, but for
    rows that by doesn't tell apart, and no window is needed but over the ranges.
    """
    columns = [c for c in rows.columns if c.lower() != name.lower()]
    at, piece, n, start = free(rows, "at", "piece", "n", "start")
    dealt = rows.repartitionByRange(pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    # the number of the partition, and the place in it in the lower 33 bits
    placed = stored(dealt.select(*columns, F.monotonically_increasing_id().alias(at)), "numbered")
    range_of = F.shiftright(F.col(at), 33)
    sizes = placed.groupBy(range_of.alias(piece)).agg(F.count(F.lit(1)).alias(n))
    starts = sizes.select(piece, (F.sum(n).over(Window.orderBy(piece)) - F.col(n)).alias(start))
    joined = placed.join(F.broadcast(starts), range_of == F.col(piece))  # as many rows as there are ranges
    return joined.select(*columns, (F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def before(totals: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """totals (keys, piece, value) with the sum of value over the pieces before."""
    w = Window.partitionBy(*keys).orderBy("piece") if keys else Window.orderBy("piece")
    return totals.withColumn(name, F.sum(value).over(w) - F.col(value))


def running(rows: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """rows (with piece, by in_pieces) with running sums of the values, in the order within the keys."""
    by = [*keys, "piece"]
    sums = rows.groupBy(*by).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    for n in values:
        sums = before(sums, keys, f"_sum_{n}", f"_before_{n}")
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_own_{n}": F.sum(v).over(within) for n, v in values.items()})
    joined = own.join(sums.select(*by, *[f"_before_{n}" for n in values]), by)
    return joined.select(*[c for c in rows.columns if c != "piece"], *[(F.col(f"_before_{n}") + F.col(f"_own_{n}")).alias(n) for n in values])


#: Rows of a key up to which they are one piece, an array.
SMALL = 10_000


def values_at(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per key the values that stand at these places, from 0, of the ascending order of value; places are made of n.

    Where the largest key has few rows, each is one array; else keys are cut into pieces. The values are the same.
    """
    sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if (sized.agg(F.max("n")).first()[0] or 0) <= SMALL:
        arrays = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_values"), F.count(F.lit(1)).alias("n"))
        return arrays.select(*keys, *[F.get("_values", p.cast("int")).alias(c) for c, p in places.items()])
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running(in_pieces(counted, keys, F.col(value)), keys, [F.col(value)], {"_upto": F.col("_n")})
    sizes = sized.select(*keys, *[p.cast("long").alias(f"_at_{c}") for c, p in places.items()])
    return upto.join(sizes, keys).groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > F.col(f"_at_{c}"), F.col(value))).alias(c) for c in places])


#: Keys that joined_by_size broadcasts, at most; each has over this part of all rows.
HOT_KEYS = 1000


def joined_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of groups, which has one row for each key of rows and in size the number of rows that it stands for.

    The keys of over a HOT_KEYS-th of all rows, which can't be more than HOT_KEYS, are broadcast; the others meet in a
    join that shuffles, where none of them is large. Keys aren't null. rows and groups are read twice.
    """
    most, hot = free(groups, "most", "hot")
    limit = F.broadcast(groups.agg((F.sum(size) / HOT_KEYS).alias(most)))
    named = groups.join(limit).select(*groups.columns, (F.col(size) > F.col(most)).alias(hot))
    few, many = named.where(F.col(hot)).drop(hot), named.where(~F.col(hot)).drop(hot)
    return rows.join(F.broadcast(few), keys).unionByName(rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys))
