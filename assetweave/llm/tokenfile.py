"""Token ids in ORC files.

Documents are encoded with a tokenizer of the tokenizers library, each followed by an end id, and written in
ascending doc_id order: the rows are dealt into ranges of doc_id, sorted, and each range is a file or several. A row
has its range and its place in it, so that the order of the files can be had from the rows. ORC keeps the ids in stripes with integer run-length encoding, with row indexes (least and greatest doc_id of every
ROW_INDEX rows) and a Bloom filter on doc_id, so a reader of some documents skips files, stripes and row groups by
their metadata, and stripes are read in parallel.

Texts are split at white space, and each distinct piece of a batch is encoded once: the tokenizer neither joins
nor looks across white space (checked against whole texts in the tests). A tokenizer that may is encoded whole.

Defined cases: a null or empty text has the end id alone; rows that repeat a doc_id follow in the order of a
hash of their texts, in the files and in the report, and each keep their ids; a null doc_id stands first; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_batches, partitions, remove_path, scratch, written
from assetweave.llm.shingles import BASE, MIX_A, MIX_B, buffers, mixed

END_ID = 1
ROW_INDEX = 1000
STRIPE_BYTES = 16 << 20
#: Of the normalizer and the first pre-tokenizer of a tokenizer that works on each white-space piece by itself.
BY_PIECES = (["NFC", "Replace", "Lowercase"], "Split")


def by_pieces(tokenizer_json: str) -> bool:
    made = json.loads(tokenizer_json)
    norm, pre = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    return [x["type"] for x in norm.get("normalizers", [])] == BY_PIECES[0] and (pre.get("pretokenizers") or [{}])[0].get("type") == BY_PIECES[1] and (pre["pretokenizers"][0]["behavior"], pre["pretokenizers"][0]["invert"]) == ("Removed", True)


class Encoder:
    """Ids of whole texts, an Arrow batch at a time.

    A piece of letters with ASCII punctuation after it is two units, any other piece is one. Arrow finds the distinct
    pieces and units of a batch; a unit is encoded once while it is remembered, the plain ones many in one call, in which
    the tokens that end words part them.
    """

    #: Plain units in one call.
    JOINED = 400
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_str(tokenizer_json), by_pieces(tokenizer_json)
        suffix = json.loads(tokenizer_json)["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.memory = Memory()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, units: list[str]) -> list[bytes]:
        """Ids of units that are one word each to the tokenizer."""
        out = []
        calls = [units[k : k + self.JOINED] for k in range(0, len(units), self.JOINED)]
        for own, e in zip(calls, self.tokenizer.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(own) and (not len(ids) or ends[-1] == len(ids)):
                data = ids.tobytes()
                low = 0
                for high in (ends * 4).tolist():
                    out.append(data[low:high])
                    low = high
            else:
                out += self._encode(own)
        return out

    def _ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, remembered or encoded now, one after another, and the units' offsets in them."""
        keys = unit_hashes(units)
        new = np.flatnonzero(~self.memory.knows(keys))
        if len(new):
            fresh = units.take(pa.array(new))
            bare = pc.utf8_rtrim(fresh, self.TAIL)
            plain = pc.or_(pc.utf8_is_alpha(fresh), pc.equal(bare, "")).to_numpy(zero_copy_only=False) & (pc.binary_length(fresh).to_numpy() > 0)
            made: list[bytes] = [b""] * len(new)
            names = fresh.to_pylist()
            for which, encode in ((np.flatnonzero(plain), self._encode_plain), (np.flatnonzero(~plain), self._encode)):
                for k, x in zip(which.tolist(), encode([names[k] for k in which.tolist()]), strict=True):
                    made[k] = x
            self.memory.add(keys[:, new], made)
        found = self.memory.ids(keys)
        return found if found is not None else stored(self._encode(units.to_pylist()))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, with an end id after each text, and the offsets of the texts in them."""
        texts = texts.fill_null("")
        # the separators 0x1C to 0x1F are white space to Arrow but not to the tokenizers
        if not self.pieces or pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            end = np.array([END_ID], np.int32).tobytes()
            rows = [r + end for r in self._encode(texts.to_pylist())]
            return np.frombuffer(b"".join(rows), np.int32), np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
        split = pc.utf8_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        # the ids of each distinct piece: those of its letters and those of its punctuation
        core, tail = parted(flat.dictionary, self.TAIL)
        cores, tails = core.dictionary_encode(), tail.dictionary_encode()
        units = pa.concat_arrays([cores.dictionary, tails.dictionary])
        both = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + len(cores.dictionary)], 1).ravel()
        piece_ids, at = gathered(*self._ids_of(units), both)
        piece_at = at[::2]
        # the end id is one more piece, put after each text's pieces
        which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        order = np.insert(which, ends, len(piece_at) - 1)
        out, at = gathered(np.append(piece_ids, np.int32(END_ID)), np.append(piece_at, len(piece_ids) + 1), order)
        return out, at[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


def parted(pieces: pa.Array, punctuation: str) -> tuple[pa.Array, pa.Array]:
    """Each piece's letters, in lower case if they are ASCII, and the punctuation after them; the whole piece and nothing
    if it isn't letters and punctuation."""
    core = pc.utf8_rtrim(pieces, punctuation)
    letters = pc.utf8_is_alpha(core)
    lower = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
    count = pc.subtract(pc.binary_length(pieces), pc.binary_length(core)).to_numpy()
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    size = np.where(letters.to_numpy(zero_copy_only=False), count, 0).astype(np.int64)
    raw = np.frombuffer(pieces.buffers()[2], np.uint8) if len(pieces) and pieces.buffers()[2] is not None else np.empty(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) + np.repeat(offsets[1:] - size - at[:-1], size)
    tail = pa.Array.from_buffers(pa.string(), len(pieces), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw[place].tobytes())])
    return pc.if_else(letters, lower, pieces), tail


def unit_hashes(units: pa.Array) -> np.ndarray:
    """Two hashes of 64 bits of each unit: sums over its bytes of a mix of byte and place."""
    raw, at = buffers(units)
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    byte = (place.astype(np.uint64) << np.uint64(8) | raw) * BASE
    out = np.empty((2, len(units)), np.uint64)
    for k, seed in enumerate((MIX_A, MIX_B)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(byte ^ seed))])
        out[k] = mixed(total[at[1:]] - total[at[:-1]])
    return out


class Memory:
    """Ids of units by two hashes of each, as sorted arrays; of more than MOST units those not used lately go."""

    MOST = 600_000

    def __init__(self) -> None:
        self.keys, self.used, self.turn = np.empty((2, 0), np.uint64), np.empty(0, np.int32), 0
        self.data, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys[0], keys[0]), max(0, self.keys.shape[1] - 1))
        return place, (self.keys[:, place] == keys).all(axis=0) if self.keys.shape[1] else np.zeros(keys.shape[1], bool)

    def knows(self, keys: np.ndarray) -> np.ndarray:
        place, hit = self._places(keys)
        self.turn += 1
        self.used[place[hit]] = self.turn
        return hit

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        if len(self.used) + len(ids) > self.MOST:
            self._keep(np.flatnonzero((self.used == self.turn) | (self.used > np.median(self.used)) if len(self.used) else []))
        at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
        data = np.concatenate([self.data, np.frombuffer(b"".join(ids), np.int32)])
        both = np.concatenate([self.keys, keys], axis=1)
        order = np.argsort(both[0], kind="stable")
        self.keys, self.used = both[:, order], np.concatenate([self.used, np.full(len(ids), self.turn, np.int32)])[order]
        self.data, self.at = gathered(data, at, order)

    def _keep(self, order: np.ndarray) -> None:
        self.data, self.at = gathered(self.data, self.at, order)
        self.keys, self.used = self.keys[:, order], self.used[order]

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and offsets of known units; None if two units have one first hash."""
        place, hit = self._places(keys)
        return gathered(self.data, self.at, place) if hit.all() else None


def stored(table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after another, and each entry's offsets in them."""
    return np.frombuffer(b"".join(table), np.int32), np.concatenate([[0], np.cumsum([len(t) for t in table]) // 4]).astype(np.int64)


def gathered(ids: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries in this order, one after another, and their offsets."""
    count = (at[1:] - at[:-1])[order]
    last = np.cumsum(count)
    narrow = np.int32 if len(ids) < 1 << 30 and (not len(last) or last[-1] < 1 << 30) else np.int64
    place = np.repeat((at[order] - last + count).astype(narrow), count)
    place += np.arange(len(place), dtype=narrow)
    return ids[place], np.concatenate([[0], last]).astype(np.int64)


#: The encoder of this Python worker, which serves one task after another.
_ENCODER: dict[str, Encoder] = {}


def encoder_of(tokenizer_json: str) -> Encoder:
    if tokenizer_json not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[tokenizer_json] = Encoder(tokenizer_json)
    return _ENCODER[tokenizer_json]


def dealt(docs: DataFrame, pieces: int) -> DataFrame:
    """docs (doc_id, text) in ranges, piece, each a partition, ascending by doc_id from partition to partition and within.

    Rows that share a doc_id follow in the order of a hash of their texts, and so can be of several ranges.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("salt", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("salt").asc()]
    return rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order, "text").select("doc_id", "text", F.spark_partition_id().alias("piece"))


STORED = "piece int, place long, doc_id long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str) -> None:
    """Writes the ids of all texts: rows (piece, place, doc_id, ids), ascending place within ascending piece."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = encoder_of(tokenizer_json), 0
        for batch in batches:
            ids, at = encoder.ids(batch["text"])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["piece"], pa.array(np.arange(place, place + len(lists))), batch["doc_id"], lists], names=["piece", "place", "doc_id", "ids"])
            place += len(lists)

    with arrow_batches(docs.sparkSession, rows=1500):
        rows = dealt(docs, partitions(docs.sparkSession)).mapInArrow(encode, STORED)
        (
            rows.write.option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES).option("orc.create.index", "true").option("orc.row.index.stride", ROW_INDEX)
            .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows written; a condition on doc_id skips stripes and row groups by their indexes and Bloom filters."""
    return spark.read.schema(STORED).orc(path)


def token_report(stored: DataFrame) -> DataFrame:
    """Per document of the stored rows: its ids' number and CRC-32, and the ids of all documents before it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            at, values = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(values[a:b]) for a, b in zip((4 * at[:-1].astype(np.int64)).tolist(), (4 * at[1:].astype(np.int64)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["piece"], batch["place"], batch["doc_id"], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["piece", "place", "doc_id", "n_tokens", "ids_crc32"])

    # written, as both uses below need them and the ids are read once that way
    with arrow_batches(stored.sparkSession):
        rows = written(stored.mapInArrow(digest, "piece int, place long, doc_id long, n_tokens long, ids_crc32 long"), "token-rows")
    # one row a range: the number of ranges is a parameter, not the data's
    sums = rows.groupBy("piece").agg(F.sum("n_tokens").alias("sum"))
    before = sums.select("piece", (F.sum("sum").over(Window.orderBy("piece")) - F.col("sum")).alias("before"))
    within = Window.partitionBy("piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(within)).join(F.broadcast(before), "piece")
    return placed.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def stored_report(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Writes the ids of docs to the shared folder, reads the files and reports on them."""
    path = scratch(docs.sparkSession, "tokens-orc")
    write_tokens(docs, path, tokenizer_json)
    report = token_report(read_tokens(docs.sparkSession, path))
    remove_path(docs.sparkSession, path)  # the report is of rows written by then
    return report
