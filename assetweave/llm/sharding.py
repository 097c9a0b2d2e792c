"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size; the shards take turns,
each claiming the first slot in its order that is still free, until the table is full. A row goes to the slot
that its key's hash names, and so to that slot's shard: constant time for a row, shards within one slot of
each other in size, and few moves when a shard comes or goes. The table's size is a parameter, not a property
of the data, and it is broadcast.

Only DataFrame and SQL functions touch the rows. Defined cases: a null key is placed as the text 'null' is;
equal and repeated keys share a shard, however many they are and however long; an empty table gives no rows; extra columns
pass through, of which slot and shard are overwritten.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 24
SLOTS = 2503


def number(text: str) -> int:
    """The first 15 hexadecimal digits of the text's MD5 as an integer."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The index of the shard that has each slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < len(shards):
        raise ValueError("the number of slots must be prime and at least the number of shards")
    start = [number(f"start:{s}") % slots for s in shards]
    step = [number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    taken, turn = [-1] * slots, 0
    tried = [0] * len(shards)
    while turn < slots:
        k = turn % len(shards)
        while taken[slot := (start[k] + step[k] * tried[k]) % slots] >= 0:
            tried[k] += 1
        taken[slot] = k
        turn += 1
    return taken


def key_slot(key: Column, slots: int) -> Column:
    """The slot that a key's hash names."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark, shards: list[str], slots: int) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    digits = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(digits), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place(df: DataFrame, key: str = "doc_id", n_shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard, by a broadcast join with the lookup table; no shuffle."""
    table = F.broadcast(table_frame(df.sparkSession, shard_names(n_shards), slots))
    kept = df.drop("slot", "shard")
    return kept.withColumn("slot", key_slot(F.col(key), slots)).join(table, "slot").select(*kept.columns, "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", n_shards: int = SHARDS, slots: int = SLOTS, files: int = 1) -> None:
    """Writes one folder for each shard, each of some files, which divide the shard's slots."""
    placed = place(df, key, n_shards, slots)
    placed.repartition(n_shards * files, "shard", F.pmod("slot", F.lit(files))).write.partitionBy("shard").parquet(path)


#: The same table and placement in DuckDB: one step of the recursion is one claim.
ORACLE = f"""
WITH RECURSIVE pref AS (
  SELECT list(('0x' || md5('start:' || n)[1:15])::BIGINT % {SLOTS} ORDER BY k) AS start,
         list(('0x' || md5('step:' || n)[1:15])::BIGINT % {SLOTS - 1} + 1 ORDER BY k) AS step
  FROM (SELECT k, 'shard-' || lpad(k::VARCHAR, 5, '0') AS n FROM range({SHARDS}) t(k))),
fill(turn, slot, taken, tried) AS (
  SELECT 0, -1::BIGINT, list_transform(range({SLOTS}), lambda x: false), list_transform(range({SHARDS}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT turn + 1, (p.start[k + 1] + p.step[k + 1] * j) % {SLOTS},
         list_transform(taken, lambda x, i: x OR i = (p.start[k + 1] + p.step[k + 1] * j) % {SLOTS} + 1),
         list_transform(tried, lambda x, i: CASE WHEN i = k + 1 THEN j ELSE x END)
  FROM (SELECT turn, taken, tried, k, list_filter(range(tried[k + 1], {SLOTS}), lambda j: NOT taken[(start[k + 1] + step[k + 1] * j) % {SLOTS} + 1])[1] AS j
        FROM (SELECT *, turn % {SHARDS} AS k FROM fill, pref WHERE turn < {SLOTS})) f, pref p),
lookup AS (SELECT slot, ((turn - 1) % {SHARDS})::INT AS shard FROM fill WHERE turn > 0)
SELECT d.doc_id, l.slot::INT AS slot, l.shard
FROM documents d JOIN lookup l ON l.slot = ('0x' || md5(coalesce(d.doc_id::VARCHAR, 'null'))[1:15])::BIGINT % {SLOTS}
"""
