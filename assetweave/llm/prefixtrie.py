"""Trie of conversations that share their first turns, by composable fingerprints.

A conversation c is rebuilt from the head of a base conversation and the rest of its own turns. No rebuilt text is made: a
sequence of turns has the fingerprint sum(e(turn) * BASE ** (turns after it)) modulo a prime, and two fingerprints compose
as a * BASE ** len(b) + b. The fingerprints of all prefixes of a rebuilt conversation follow from those of the original
ones: own(pos) + (head - own(h)) * BASE ** (pos - h), where only the last factor changes along the conversation.

Original turns are dealt by ranges of (conversation, turn), and each range is scanned once; a conversation that spans
ranges has the fingerprints of its pieces composed. So one conversation with most of the turns is shared out.

A turn's reference is the MD5 of its role and text. Stored turns hold each role and text once, by reference; a reference
with two of them raises an error. A node is a (depth, fingerprint); its members' last turns have to have one reference,
which by induction shows that their prefixes are equal, as equal fingerprints and equal last turns leave equal
fingerprints before. A node whose members differ raises an error.

Sums over subtrees are sums over members: a leaf counts at the ancestors of its smallest member, and along a conversation
the text of the nodes of which it isn't the smallest member is what it saves. So nothing goes through the tree level by level.

Defined cases: a null role or text is empty; turns are ordered by turn, null first, and by reference where that is equal;
rows of one conversation that are wholly alike are turns of their own; rows without conv_id belong to no
conversation and are left out; a base conversation that isn't there has no turns; an empty table gives no nodes; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_batches, joined_by_size, partitions, remove, written

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
#: A conversation's base is the one whose number is the last multiple of this; its head is of fewer than HEADS turns.
STRIDE, HEADS = 100, 6
#: Conversation numbers whose decimal texts are joined in one task before they are digested: two to this power.
BLOCK_BITS = 12

SCANNED = "conv_id long, piece int, i long, own binary, ref binary, n_chars long, upto long, last boolean"
FIRST = "struct<piece:int,i:bigint,ref:binary,n_chars:bigint>"
PLACED = "conv_id long, length long, head array<struct<depth:bigint,fp:binary,ref:binary,n_chars:bigint,upto:bigint>>, pieces array<struct<piece:int,lift:binary,after:bigint,shift:bigint,chars:bigint>>"


def element(ref: bytes) -> int:
    return int.from_bytes(ref, "big") % PRIME


def stored(fp: int) -> bytes:
    return fp.to_bytes(16, "big")


def turn_rows(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ref, n_chars) of the rows that have a conv_id."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = convs.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    ref = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("*", ref.alias("ref"), F.length("text").cast("long").alias("n_chars"))


def stored_turns(convs: DataFrame) -> DataFrame:
    """(ref, role, text): each role and text of all turns once, checked to have references of their own."""
    found = written(turn_rows(convs).groupBy("ref", "role", "text").agg(F.count(F.lit(1)).alias("n")), "turns")
    if not found.groupBy("ref").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        raise ValueError("two different turns have one reference")
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with the fingerprint and code points of their conversation so far, within this range."""
    piece, held = TaskContext.get().partitionId(), None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "piece", "i", "own", "ref", "n_chars", "upto", "last"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    conv, i, own, upto = None, 0, 0, 0
    for batch in batches:
        rows = []
        for c, ref, n in zip(*(batch[k].to_pylist() for k in ("conv_id", "ref", "n_chars")), strict=True):
            if held is not None:
                rows.append((*held, c != conv))
            if c != conv:
                conv, i, own, upto = c, 0, 0, 0
            i, own, upto = i + 1, (own * BASE + element(ref)) % PRIME, upto + n
            held = (c, piece, i, stored(own), ref, n, upto)
        if rows:
            yield out(rows)
    if held is not None:
        yield out([(*held, True)])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation: the nodes of its head, and what turns the scanned fingerprints of a piece into rebuilt ones."""
    kind = pa.schema([("conv_id", pa.int64()), ("length", pa.int64()), ("head", pa.list_(pa.struct([("depth", pa.int64()), ("fp", pa.binary()), ("ref", pa.binary()), ("n_chars", pa.int64()), ("upto", pa.int64())]))), ("pieces", pa.list_(pa.struct([("piece", pa.int32()), ("lift", pa.binary()), ("after", pa.int64()), ("shift", pa.int64()), ("chars", pa.int64())])))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            h = row["h"]
            first = lambda rows: sorted(rows or [], key=lambda r: (r["piece"], r["i"]))[:h]  # noqa: B023, E731
            head, fp, chars = [], 0, 0
            for d, t in enumerate(first(row["base_firsts"]), 1):
                fp, chars = (fp * BASE + element(t["ref"])) % PRIME, chars + t["n_chars"]
                head.append({"depth": d, "fp": stored(fp), "ref": t["ref"], "n_chars": t["n_chars"], "upto": chars})
            skipped, skipped_chars = 0, 0
            for t in first(row["firsts"]):
                skipped, skipped_chars = (skipped * BASE + element(t["ref"])) % PRIME, skipped_chars + t["n_chars"]
            pieces, before, own, upto = [], 0, 0, 0
            for p in sorted(row["pieces"], key=lambda p: p["piece"]):
                if before + p["i"] > h:
                    lift = (own + (fp - skipped) * pow(BASE, before - h, PRIME)) % PRIME
                    pieces.append({"piece": p["piece"], "lift": stored(lift), "after": h - before, "shift": before - h + len(head), "chars": upto - skipped_chars + chars})
                before, own, upto = before + p["i"], (own * pow(BASE, p["i"], PRIME) + int.from_bytes(p["own"], "big")) % PRIME, upto + p["upto"]
            out.append({"conv_id": row["conv_id"], "length": len(head) + max(0, before - h), "head": head, "pieces": pieces})
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def _lifted(own: pd.Series, lift: pd.Series, i: pd.Series) -> pd.Series:
    number = lambda b: int.from_bytes(b, "big")
    return pd.Series([stored((number(o) + number(k) * pow(BASE, n, PRIME)) % PRIME) for o, k, n in zip(own, lift, i, strict=True)], dtype=object)


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, length, depth, fp, ref, n_chars, upto): each prefix of each rebuilt conversation, from the empty one;
    length is that of the conversation, n_chars the code points of the last turn and upto those of all."""
    spark = convs.sparkSession
    turns = turn_rows(convs).select("conv_id", "turn", "ref", "n_chars").repartitionByRange(partitions(spark), "conv_id", F.col("turn").asc_nulls_first(), "ref")
    in_order = turns.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "ref").select("conv_id", "ref", "n_chars")
    with arrow_batches(spark, 10_000):
        scanned = written(in_order.mapInArrow(_scan, SCANNED), "scanned")
        firsts = F.collect_list(F.when(F.col("i") < HEADS, F.struct("piece", "i", "ref", "n_chars"))).alias("firsts")
        pieces = F.collect_list(F.when(F.col("last"), F.struct("piece", "i", "own", "upto"))).alias("pieces")
        each = written(scanned.groupBy("conv_id").agg(firsts, pieces).withColumn("base", F.col("conv_id") - F.col("conv_id") % STRIDE), "conversations")
        bases = each.where("conv_id = base").select("base", F.col("firsts").alias("base_firsts"))
        both = each.join(bases, "base", "left").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
        placed = written(both.select("conv_id", "h", "firsts", "pieces", "base_firsts").mapInArrow(_placed, PLACED), "placed")
        none = F.unhex(F.lit(stored(0).hex()))
        root = placed.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), none.alias("fp"), none.alias("ref"), F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("upto"))
        heads = placed.select("conv_id", "length", F.inline("head"))
        rest = scanned.join(placed.select("conv_id", "length", F.inline("pieces")), ["conv_id", "piece"]).where("i > after")
        rest = rest.select("conv_id", "length", (F.col("i") + F.col("shift")).alias("depth"), F.pandas_udf(_lifted, "binary")("own", "lift", "i").alias("fp"), "ref", "n_chars", (F.col("upto") + F.col("chars")).alias("upto"))
        out = written(root.unionByName(heads).unionByName(rest), "prefixes")
    for used in (scanned, each, placed):
        remove(spark, used)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's chunks, which come one after another; only the running digest is held."""
    now, running, done = None, None, []
    for batch in batches:
        for depth, fp, chunk in zip(*(batch[k].to_pylist() for k in ("depth", "fp", "chunk")), strict=True):
            if (depth, fp) != now:
                if now is not None:
                    done.append((*now, running.hexdigest()))
                now, running = (depth, fp), hashlib.sha256()
            else:
                running.update(b",")
            running.update(chunk.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "fp", "ends_sha256"])
            done = []
    if now is not None:
        done.append((*now, running.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "fp", "ends_sha256"])


def ends(prefixes: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of the nodes at which conversations end: the digest of their numbers, joined by commas."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    chunk = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("chunk")
    chunks = prefixes.where("depth = length").groupBy("depth", "fp", block).agg(chunk)
    return chunks.repartition(partitions(prefixes.sparkSession), "depth", "fp").sortWithinPartitions("depth", "fp", "block").mapInArrow(_digests, "depth long, fp binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations: fp, ref (the last turn's reference) and the columns of node_report."""
    spark = convs.sparkSession
    remove(spark, stored_turns(convs))
    prefixes = rebuilt(convs)
    one_turn = F.when(F.min("ref") == F.max("ref"), F.min("conv_id")).otherwise(F.raise_error(F.lit("two prefixes have one fingerprint")).cast("long"))
    nodes = written(prefixes.groupBy("depth", "fp").agg(one_turn.alias("top"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends")), "nodes")
    members = written(joined_by_size(prefixes.drop("ref"), nodes, ["depth", "fp"], "n_convs"), "members")
    # along a conversation: from which depth on it is the smallest member, and what there is before
    smallest = F.col("top") == F.col("conv_id")
    facts = members.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_prefixes"),
        F.min(F.when(smallest, F.col("depth"))).alias("entry"),
        F.coalesce(F.max(F.when(~smallest, F.col("upto"))), F.lit(0)).alias("shared"),
        F.max(F.when(~smallest, F.struct("depth", "top"))).alias("above"),
        F.max(F.when(smallest & (F.col("depth") == F.col("length")) & (F.col("n_convs") == F.col("n_ends")), 1).otherwise(0)).alias("leaf"),
    )
    facts = written(facts.select("conv_id", "n_prefixes", "entry", "shared", F.col("above.top").alias("above"), "leaf"), "facts")
    rows = joined_by_size(members, facts, ["conv_id"], "n_prefixes")
    parent = F.when(smallest & (F.col("depth") > 0), F.when(F.col("entry") < F.col("depth"), F.col("conv_id")).otherwise(F.col("above")))
    child = (F.col("entry") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    saved = F.when(smallest, F.lit(0)).otherwise(F.col("shared") - F.col("upto") + F.col("n_chars"))
    whole = rows.groupBy("depth", "fp").agg(F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    out = written(whole.join(ends(prefixes), ["depth", "fp"], "left"), "trie")
    for used in (prefixes, nodes, members, facts):
        remove(spark, used)
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def node_report(convs: DataFrame) -> DataFrame:
    """Per node: its smallest member, depth, parent's smallest member, members, children, leaves and code points saved in
    its subtree, and the digest of the conversations that end in it."""
    return trie(convs).select(*NODE)


ORACLE = f"""
WITH crc AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
c AS (SELECT conv_id, conv_id - conv_id % {STRIDE} AS base, xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(x) for x in string_split(conv_id::VARCHAR, '')]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS path, length(text) AS size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS (SELECT * FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended, min(conv_id) OVER (PARTITION BY depth, path) AS top FROM p),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, bool_and(ended) AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM e GROUP BY depth, path),
u AS (SELECT n.*, a.top AS parent_conv_id FROM n LEFT JOIN e a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1),
s AS (SELECT e.depth, e.path, count(*) FILTER (WHERE u.leaf) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved_tokens FROM u JOIN e ON e.conv_id = u.conv_id AND e.depth <= u.depth GROUP BY e.depth, e.path),
k AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY 1, 2)
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM u JOIN s USING (depth, path) LEFT JOIN k ON k.depth = u.depth AND k.conv_id = u.conv_id
"""
