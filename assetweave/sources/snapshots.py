"""Readers of the sources' JSON snapshots and writers of the results."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assetweave.sources.jsonarrays import elements, parsed
from assetweave.sources.versions import Folder, publish, versions

USD = "struct<price:double,market_cap:double,volume_24h:double,percent_change_24h:double>"
LISTING = f"struct<id:bigint,name:string,symbol:string,slug:string,tags:array<string>,cmc_rank:int,date_added:string,circulating_supply:double,total_supply:double,max_supply:double,platform:struct<name:string,slug:string,symbol:string,token_address:string>,quote:struct<USD:{USD}>>"
LINK = "struct<network:string,name:string,contract:string,contract_address:string,supply:double,amount:double,share:double,percentage:double>"
#: The names that a breakdown may have, in the order in which they are tried.
BREAKDOWNS = ["networkBreakdown", "network_breakdown", "breakdown", "networks", "chains", "platforms"]
METRIC = "struct<id:string,name:string,symbol:string,slug:string,tags:array<string>,supply:struct<circulating:double,total:double,max:double>,profile:struct<general:struct<overview:struct<project_details:string,official_links:array<struct<link:string>>>>,images:struct<logo:string>>," + ",".join(f"{b}:string" for b in BREAKDOWNS) + ">"
AMOUNTS = "map<string,double>"
PEGGED = f"struct<id:string,name:string,symbol:string,pegType:string,pegMechanism:string,price:double,circulating:{AMOUNTS},chains:array<string>,chainCirculating:map<string,struct<current:{AMOUNTS},circulatingPrevDay:{AMOUNTS},circulatingPrevWeek:{AMOUNTS},circulatingPrevMonth:{AMOUNTS}>>>"
MARKET = "struct<id:string,symbol:string,name:string,image:string,current_price:double,market_cap:double,total_volume:double,price_change_percentage_24h:double,market_cap_rank:int,circulating_supply:double,total_supply:double>"


def scan_listings(spark: SparkSession, path: str) -> DataFrame:
    """{data: [...]}, one row an asset."""
    return parsed(elements(spark, path, "data"), LISTING)


def scan_supply_metrics(spark: SparkSession, path: str) -> DataFrame:
    """{data: [...]} or a bare array; breakdown is the first non-empty of BREAKDOWNS, an array or an object's values."""
    rows = parsed(elements(spark, path, "data"), METRIC)

    def listed(c: str):
        array = F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{LINK}>"))
        flat = F.from_json(c, f"map<string,{LINK}>")
        deep = F.from_json(c, f"map<string,array<{LINK}>>")
        values = F.when(F.ltrim(c).rlike(r'^\{\s*"[^"]*"\s*:\s*\['), F.flatten(F.map_values(deep))).otherwise(F.map_values(flat))
        found = F.coalesce(array, F.when(F.ltrim(c).startswith("{"), values))
        return F.when(F.size(found) > 0, found)

    return rows.withColumn("breakdown", F.coalesce(*[listed(b) for b in BREAKDOWNS])).drop(*[b for b in BREAKDOWNS if b != "breakdown"])


def scan_chain_supply(spark: SparkSession, path: str) -> DataFrame:
    """{peggedAssets: [...]}; a snapshot without them is an error."""
    return parsed(elements(spark, path, "peggedAssets", needed=True), PEGGED)


def scan_markets(spark: SparkSession, path: str) -> DataFrame:
    """A bare array."""
    return parsed(elements(spark, path), MARKET)


def scan_distinct_pegs(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("pegType").alias("peg_type")).where("peg_type <> ''").distinct().orderBy("peg_type")


#: Readers by source; others may be added under their own names.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"cmc": scan_listings, "messari": scan_supply_metrics, "defillama": scan_chain_supply, "coingecko": scan_markets}


def sink_snapshot(rows: DataFrame, path: str, eligible=None) -> dict[str, int]:
    """Puts rows (source, snapshot_ts, ...) into a table partitioned by both; counts rows and eligible ones on the way.

    A snapshot is replaced as a whole when it is written again, and comes in sight when all of it is written; others stay.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("raw")] + ([F.count_if(eligible).alias("eligible")] if eligible is not None else [])
    rows.observe(seen, *counts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "snapshot_ts").parquet(path)
    return seen.get


#: Rows of a file of the gold tables, at most.
FILE_ROWS = 1_000_000


def sink_gold(rows: DataFrame, path: str, by: str, number: int = 0, file_rows: int = FILE_ROWS) -> bool:
    """One folder for each value of a column, as version number of path (see versions); False if that is there already.

    A value with many rows is shared out over tasks and files of at most file_rows; small ones share a task.
    """
    spark, (size, salt) = rows.sparkSession, ("_size", "_salt")
    sizes = rows.groupBy(F.col(by).alias("_value")).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > file_rows)
    # values of more than a file: as many as there are files at most
    sized = rows.join(sizes, F.col(by).eqNullSafe(F.col("_value")), "left").drop("_value")
    # more parts than files, so that chance fills none of them beyond the limit by much; the writer cuts what is over
    parts = F.ceil(F.coalesce(F.col(size), F.lit(1)) * 1.2 / file_rows)
    dealt = sized.withColumn(salt, F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), parts)).repartition(by, salt).drop(size, salt)
    return publish(spark, path, number, lambda to: dealt.write.option("maxRecordsPerFile", file_rows).partitionBy(by).parquet(to))


#: Folders of prefixes, which are also the tasks that write them.
PREFIXES = 256
#: What Spark writes in another way in the name of a partition's folder.
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Rows of many small files that are handed on together.
READ_ROWS = 10_000


def sink_gold_by_asset(rows: DataFrame, path: str, by: str, number: int = 0, prefix: str = "prefix") -> bool:
    """One folder for each asset, under folders of the first two hex digits of its digest, so that none has too many.

    A task has all assets of a prefix. On a mounted file system it writes their files by Arrow, since Hadoop's local file system starts
    a process or more for each file and folder; on any other one Spark writes them.
    """
    dealt = rows.withColumn(by, F.col(by).cast("string")).withColumn(prefix, F.substring(F.md5(by), 1, 2)).repartition(PREFIXES, prefix).sortWithinPartitions(prefix, by)

    def write(to: str) -> None:
        local = Folder(rows.sparkSession, to).local()
        if local is None:
            dealt.write.partitionBy(prefix, by).parquet(to)
        else:
            os.makedirs(local)
            dealt.mapInArrow(_asset_files(local, by, prefix), "files long").agg(F.sum("files")).collect()
            for left in os.scandir(local):
                if left.name.startswith("_attempt-"):
                    shutil.rmtree(left.path)

    return publish(rows.sparkSession, path, number, write)


def _asset_files(to: str, by: str, prefix: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes rows, sorted by prefix and asset, as a file for each asset. A prefix comes in sight as a whole; one that another attempt has put there stays."""

    # within, so that workers needn't import this module
    def folder(column: str, value: str | None) -> str:
        return f"{column}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else NO_VALUE}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, files, at, out = f"{to}/_attempt-{uuid.uuid4().hex}", 0, None, None

        def show(prefix_folder: str) -> None:
            try:
                os.rename(f"{own}/{prefix_folder}", f"{to}/{prefix_folder}")
            except OSError:
                if not os.path.isdir(f"{to}/{prefix_folder}"):
                    raise

        for batch in batches:
            assets, prefixes = (batch.column(c) for c in (by, prefix))
            data = batch.drop_columns([by, prefix])
            ends = pc.run_end_encode(assets).run_ends.to_pylist()
            for start, end in zip([0, *ends], ends):
                folders = folder(prefix, prefixes[start].as_py()), folder(by, assets[start].as_py())
                if folders != at:
                    if out is not None:
                        out.close()
                        if folders[0] != at[0]:
                            show(at[0])
                    os.makedirs(f"{own}/{'/'.join(folders)}")
                    out = pq.ParquetWriter(f"{own}/{'/'.join(folders)}/part-0.parquet", data.schema, use_dictionary=False, store_schema=False)
                    at, files = folders, files + 1
                out.write_batch(data.slice(start, end - start))
        if out is not None:
            out.close()
            show(at[0])
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def gold_by_asset(spark: SparkSession, path: str, by: str, schema: StructType, prefix: str = "prefix") -> DataFrame | None:
    """The newest rows that sink_gold_by_asset has put into path; schema: theirs, without by and prefix, which follow as strings.

    On a mounted file system tasks list and read a prefix each, so that the folders of all assets aren't listed in the driver.
    """
    found = versions(spark, path)
    if not found:
        return None
    whole = StructType([*schema.fields, StructField(prefix, StringType()), StructField(by, StringType())])
    top = f"{path}/version={found[-1]}"
    local = Folder(spark, top).local()
    if local is None:
        return spark.read.schema(whole).parquet(top)
    names = [(n,) for n in Folder(spark, top).names() if n.startswith(f"{prefix}=")]
    return spark.createDataFrame(names, "name string").repartition(PREFIXES, "name").mapInArrow(_asset_rows(local, by, prefix, whole.fieldNames()), whole)


def _asset_rows(top: str, by: str, prefix: str, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    named = lambda name: None if name.partition("=")[2] == NO_VALUE else unquote(name.partition("=")[2])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (n for batch in batches for n in batch.column(0).to_pylist()):
            held, n = [], 0
            for asset in os.scandir(f"{top}/{folder}"):
                for part in os.scandir(asset.path):
                    with pq.ParquetFile(part.path) as file:
                        for batch in file.read(use_threads=False).to_batches() if file.metadata.num_rows <= READ_ROWS else file.iter_batches(READ_ROWS):
                            held.append(batch.append_column(prefix, pa.repeat(pa.scalar(named(folder), pa.string()), len(batch))).append_column(by, pa.repeat(pa.scalar(named(asset.name), pa.string()), len(batch))).select(columns))
                            n += len(batch)
                            if n >= READ_ROWS:
                                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                                held, n = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return read
