"""Elements of large JSON arrays, read by many tasks.

A snapshot is one document, {"data": [{...}, ...]} or a bare array, on one line or many. Spark's text source splits it into byte ranges
if records end with a text that occurs all over the document; here with "},", after each inner or whole object. What such
a piece does to the reader's state, whether it is in a string and how deep it is nested, is a function of the state before; these functions
compose, within a byte range and over the ranges, so that each piece's state is known and pieces are put together to
elements again. No task holds a document, only an element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetweave.operators.ordered import stored

END = "},"


def _nesting(text: Column) -> Column:
    """Brackets that open less those that close."""
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return count(r"[{\[]") - count(r"[}\]]")


def elements(spark: SparkSession, path: str, field: str | None = None, needed: bool = False) -> DataFrame:
    """(file, element, text): the objects of each document's array, numbered from 0 in their order.

    A document that begins with [ is the array; of another one it is the array under field, at the top level. needed: a
    document without it is an error, which comes up when the rows are read; else it has no elements. Objects that are broken
    inside come out as they are; brackets that don't match, outside strings, end what can be told apart.
    """
    marker = rf'"{field}"\s*:\s*\['
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", END).text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    # texts between quotes, without what is escaped: by turns outside and inside strings
    parts = F.split(F.regexp_replace("text", r"\\.", ""), '"')
    side = lambda k: _nesting(F.array_join(F.filter(parts, lambda x, i: i % 2 == k), " "))
    pieces = stored(raw.select("*", (F.size(parts) - 1).alias("quotes"), side(0).alias("even"), side(1).alias("odd")), "pieces")

    order = Window.partitionBy("file", "block").orderBy("at")  # a byte range, of one task
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    quotes = F.sum("quotes").over(upto)
    # by the state at the range's begin, outside a string (0) or in one (1): the change of depth, with the end's bracket
    change = lambda s: F.when((quotes - F.col("quotes") + s) % 2 == 0, F.col("even")).otherwise(F.col("odd")) - F.when((quotes + s) % 2 == 0, 1).otherwise(0)
    own = pieces.select("file", "block", "at", "text", quotes.alias("quotes"), change(0).alias("c0"), change(1).alias("c1"))
    own = stored(own.withColumns({"d0": F.sum("c0").over(upto), "d1": F.sum("c1").over(upto)}), "states")

    blocks = own.groupBy("file", "block").agg(F.max("quotes").alias("quotes"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    by_file = Window.partitionBy("file").orderBy("block")  # a row for each range
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    blocks = blocks.withColumn("inside", inside).withColumn("c", F.when(F.col("inside") == 0, F.col("c0")).otherwise(F.col("c1")))
    starts = blocks.select("file", "block", "inside", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))

    chosen = lambda a, b: F.when(F.col("inside") == 0, F.col(a)).otherwise(F.col(b))
    deep = own.join(starts, ["file", "block"]).select("file", "block", "at", "text", (F.col("start") + chosen("d0", "d1")).alias("depth"), (F.col("start") + chosen("d0", "d1") - chosen("c0", "c1")).alias("depth_before"), ((F.col("quotes") + F.col("inside")) % 2).alias("open_string"))
    first = F.min_by(F.substring(F.ltrim("text"), 1, 1), F.struct("block", "at"))
    found = F.min(F.when((F.col("depth_before") <= 1) & F.col("text").rlike(marker), F.struct("block", "at"))) if field else F.lit(None).cast("struct<block:bigint,at:bigint>")
    files = deep.groupBy("file").agg(first.alias("first"), found.alias("marked"))
    bare = F.col("first") == "["
    if needed:
        gone = F.raise_error(F.concat(F.lit(f"there is no array {field} in "), "file")).cast("boolean")
        files = files.where(F.when(~F.coalesce(bare, F.lit(False)) & F.col("marked").isNull(), gone).otherwise(True))
    files = files.where(bare | F.col("marked").isNotNull()).select("file", F.when(bare, 1).otherwise(2).alias("base"), F.when(~bare, F.col("marked")).alias("marked"))
    here = F.struct("block", "at")
    listed = deep.join(files, "file").where(F.col("marked").isNull() | (here >= F.col("marked")))
    # a piece is of the array if it begins in it, or brings it
    brings = F.coalesce(here == F.col("marked"), F.lit(False))
    begins = F.col("marked").isNull() & (F.col("depth_before") == 0)
    bare_text = F.when(brings, F.regexp_replace("text", rf"(?s)^.*?{marker}", "")).when(begins, F.regexp_replace("text", r"(?s)^\s*\[", "")).otherwise(F.col("text"))
    listed = listed.where(brings | begins | (F.col("depth_before") >= F.col("base"))).withColumn("text", bare_text)
    ends = F.when((F.col("depth") <= F.col("base")) & (F.col("open_string") == 0), 1).otherwise(0)
    listed = stored(listed.select("file", "block", "at", "text", ends.alias("ends")), "listed")
    # an element's number is that of the ends before it
    earlier = listed.groupBy("file", "block").agg(F.sum("ends").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    number = F.col("n") + F.sum("ends").over(upto) - F.col("ends")
    numbered = listed.join(earlier, ["file", "block"]).select("file", number.alias("element"), "block", "at", "text")
    whole = numbered.groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda x: x["text"]), END).alias("text"))
    # what follows the array's last object has brackets that close it; the object's own is put back with the others
    text = F.regexp_extract(F.col("text"), r"(?s)^[\s,]*(\{.*)$", 1)
    closed = F.when(_closes(text), text).otherwise(F.concat(text, F.lit("}")))
    return whole.select("file", "element", closed.alias("text")).where("text <> ''")


def _closes(text: Column) -> Column:
    """Whether brackets outside strings close at least as often as they open."""
    outside = F.array_join(F.filter(F.split(F.regexp_replace(text, r"\\.", ""), '"'), lambda x, i: i % 2 == 0), " ")
    return _nesting(outside) <= 0


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of elements by schema (struct<...>), without those that are broken."""
    return _read(rows, schema).where("x._broken IS NULL").select("x.*").drop("_broken")


def count_broken(rows: DataFrame, schema: str) -> DataFrame:
    """(file, n, n_broken): each document's elements, and how many of them can't be read by schema."""
    return _read(rows, schema).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count("x._broken").alias("n_broken"))


def _read(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select("file", F.from_json("text", schema.removesuffix(">") + ",_broken:string>", {"columnNameOfCorruptRecord": "_broken"}).alias("x"))
