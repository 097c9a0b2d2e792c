"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line without the ASCII white space at its ends, A-Z lower-cased; its hash is the key's MD5.
A batch of documents gives a run: the keys it holds, sorted, each with the number of documents that have it.
Runs lie in levels; when a level has FANOUT runs they are merged into one run of the next level, and the keys found in
enough documents by then move to a run of settled ones. A new batch is merge-anti-joined with the settled keys and adds
a run of the others. In the end all runs are merged, and the documents' lines are joined with the keys settled, which drop
all their lines.

Only DataFrame and SQL functions touch the rows. Defined cases: a null or empty text is one empty line; keys
under the least length are never dropped; each row counts as a document, repeated ones too, whatever its doc_id;
an empty table gives an empty result; extra columns pass through, but for n_lines, n_dropped and kept_text, which are
overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.llm.common import cut_points, partitions, remove_path, scratch, unused, written

DOCUMENTS = 10
LEAST_CHARS = 1
BATCHES = 6
FANOUT = 3
#: Settled keys up to this number are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000
ENDS = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_hashes(text: Column, least_chars: int) -> Column:
    """MD5 of the key of each line; null for keys under the least length. Each step is worked out once a line."""
    bare = F.transform(lines(text), lambda x: F.trim(x, F.lit(ENDS)))
    keys = F.transform(bare, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, ascii_uppercase, ascii_lowercase)))
    return F.transform(keys, lambda x: F.when(F.length(x) >= least_chars, F.md5(x)))


class Run:
    """A sorted run (key, n) as a table in buckets of the key, each one sorted file, in the shared folder."""

    def __init__(self, counted: DataFrame, buckets: int):
        self.spark, self.path = counted.sparkSession, scratch(counted.sparkSession, "line-run")
        self.name = "line_run_" + self.path[-32:]
        # counted is dealt by the key already, so that all rows of a bucket come from one task
        counted.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        """The run in its buckets. A union of such rows isn't to be grouped: it claims to be in buckets, but isn't."""
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The run as files like others."""
        return self.spark.read.schema("key binary, n long").parquet(self.path)

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove_path(self.spark, self.path)


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """What runs within takes buckets of one file as sorted, and reads them as buckets."""
    names = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


class LineRuns:
    """Levels of runs of keys not settled yet, and the run of the settled ones.

    The runs and the settled keys are in the same buckets, in order, so that a batch is anti-joined with the settled keys
    and runs are merged bucket by bucket, without an exchange or a sort of what is stored.
    """

    def __init__(self, spark: SparkSession, documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS, fanout: int = FANOUT):
        self.spark, self.documents, self.least_chars, self.fanout = spark, documents, least_chars, fanout
        self.buckets = partitions(spark)
        self.levels: list[list[Run]] = [[]]
        self.done: Run | None = None

    def counts(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(key, n) of a batch: in how many rows of docs each key is, but for the settled ones."""
        hashes = key_hashes(F.col(text), self.least_chars)
        new = docs.select(F.explode(F.array_distinct(F.array_compact(hashes))).alias("key")).select(F.unhex("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        if self.done is None:
            return new
        # not an anti-join by name, as that would be moved below the count and meet every line
        done = self.done.rows().select(F.col("key").alias("settled")).hint("merge")
        return new.join(done, F.col("key") == F.col("settled"), "left").where("settled IS NULL").select("key", "n")

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Adds a batch as a run; a level that is full is merged into one run of the next level."""
        with sorted_scans(self.spark):
            self.levels[0].append(Run(self.counts(docs, text), self.buckets))
            for k in range(len(self.levels)):
                if len(self.levels[k]) >= self.fanout:
                    self._merge(k)

    def _merge(self, level: int) -> None:
        """The keys of the level that have enough documents go to the settled ones, the others to the next level."""
        old, done = self.levels[level], self.done
        if level + 1 == len(self.levels):
            self.levels.append([])
        whole = old[0]
        for run in old[1:]:
            whole, last = Run(merged(whole.rows(), run.rows()), self.buckets), whole
            last.remove()
            run.remove()
        enough = F.col("n") >= self.documents
        settled = whole.rows().where(enough)
        self.done = Run(settled if done is None else merged(done.rows(), settled), self.buckets)
        self.levels[level + 1].append(Run(whole.rows().where(~enough), self.buckets))
        self.levels[level] = []
        whole.remove()
        if done is not None:
            done.remove()

    def settled(self) -> DataFrame | None:
        """Keys that have been found in enough documents, in all runs together."""
        runs = [r.files() for level in self.levels for r in level]
        if self.done is not None:
            runs.append(self.done.files())
        return reduce(DataFrame.union, runs).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= self.documents).select("key") if runs else None

    def remove(self) -> None:
        """Deletes all runs."""
        for run in [*(r for level in self.levels for r in level), *([self.done] if self.done else [])]:
            run.remove()
        self.levels, self.done = [[]], None


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' keys with their numbers added, bucket by bucket."""
    both = a.toDF("key_a", "n_a").join(b.toDF("key_b", "n_b").hint("merge"), F.col("key_a") == F.col("key_b"), "full")
    return both.select(F.coalesce("key_a", "key_b").alias("key"), (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"))


def drop_lines(docs: DataFrame, runs: LineRuns, text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: the lines whose keys the runs haven't settled."""
    kept_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    docs = docs.select(*kept_columns)
    count = F.size(lines(F.col(text))).cast("long")
    settled = runs.settled()
    if settled is None:
        return docs.withColumns({"n_lines": count, "n_dropped": F.lit(0).cast("long"), "kept_text": F.coalesce(F.col(text), F.lit(""))})
    settled = written(settled, "line-settled")
    if settled.count() <= BROADCAST_KEYS:
        settled = F.broadcast(settled)
    own, body, flags, dropped = unused(docs, "own", "body", "flags", "dropped")
    hashed = docs.select(F.col("doc_id").alias("own"), F.xxhash64(text).alias("body"), key_hashes(F.col(text), runs.least_chars).alias("keys")).withColumn("n", F.size("keys"))
    keyed = hashed.select("own", "body", "n", F.posexplode("keys").alias("place", "key")).where("key IS NOT NULL").withColumn("key", F.unhex("key"))
    hits = keyed.join(settled, "key").groupBy("own", "body").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("place")).alias("places"))
    # whether each line goes: the lines between two that go stay
    upto = lambda j: F.coalesce(F.get("places", j), F.col("n"))
    stretch = lambda j: F.concat(F.array_repeat(F.lit(False), upto(j) - F.coalesce(F.when(j > 0, F.get("places", j - 1)), F.lit(-1)) - 1), F.array_repeat(F.lit(True), F.when(j < F.size("places"), 1).otherwise(0)))
    hits = hits.select(F.col("own").alias(own), F.col("body").alias(body), F.size("places").cast("long").alias(dropped), F.flatten(F.transform(F.sequence(F.lit(0), F.size("places")), stretch)).alias(flags))
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits[own]) & (F.xxhash64(docs[text]) == hits[body]), "left")
    kept = F.filter(lines(F.col(text)), lambda x, i: ~F.get(F.col(flags), i))
    return joined.select(
        *[docs[c] for c in kept_columns],
        count.alias("n_lines"),
        F.coalesce(F.col(dropped), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(flags).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """Feeds docs to new runs, in batches of doc_id ranges, and drops the lines of all settled keys."""
    runs = LineRuns(docs.sparkSession, documents, least_chars)
    cuts = cut_points(docs, "doc_id", batches)
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    for low, high in bounds:
        where = F.lit(True)
        if low is not None:
            where &= F.col("doc_id") >= low
        if high is not None:
            where &= F.col("doc_id") < high
        runs.add(docs.where(where | F.col("doc_id").isNull() if low is None else where))
    out = drop_lines(docs, runs)  # which has written the settled keys
    runs.remove()
    return out


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: its lines, the lines dropped, and the digest of what is kept."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT rid, doc_id, generate_subscripts(ls, 1) AS place, unnest(ls) AS line
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT rid) >= {DOCUMENTS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY rid
"""
