"""Spelling variants of words, found by an index of variable-length grams.

The words of a table of texts are counted. Grams have two to MOST characters of a word and its end mark; the dictionary
prunes by frequency: a gram that more than FREQUENT places have is replaced by those that are one character longer. A
word's gram at a place is the shortest from there that isn't frequent, so it hangs on its own characters alone and an edit
changes just the grams that it touches. What an edit at the worst place of a word touches, is counted for each word: the word
keeps all its grams but that many. So of its rarest grams one more than that number are enough to find every word near it.

The index holds those few grams of each word, with the places at which a longer or equally long word has to have them:
the gram stands before the edit or after it. All grams of all words meet the index in an equi-join, the lists of a word are
merged to candidates, and candidates are compared. As lists of grams are short but for those of MOST characters, and a
word's rarest grams come first, frequent endings don't bring their words together.

A word's form is the near word that occurs most, if that is RATIO times as often; roots are found by doubling forms.

Defined cases: a null text has no words, and empty ones neither; a null doc_id is written null in the hash of its runs;
each row counts, repeated ones too; two near words of one number are ordered by code points; an empty table has no words; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_batches, remove, written

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Every so many runs, by hash, one loses a character.
SPOILT = 199
#: Characters of the longest gram. One less than LEAST_CHARS at most: then an edit leaves a gram of any word alone.
MOST = 5
#: Places of a word that a gram can have without being replaced by longer ones.
FREQUENT = 32
#: Frequent grams up to this number are broadcast, some 40 bytes each.
BROADCAST_GRAMS = 200_000
#: Words that a task counts before it hands them on.
HELD = 200_000
END = "\n"

#: The characters of runs, as UTF-8: A-Z, a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LOWER = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their numbers, as far as a task holds them."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        found = [(w, n) for w, n in ((b.decode(), n) for b, n in held.items()) if len(w) >= LEAST_CHARS]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            raw = text.as_buffer() if text.is_valid else None
            if raw is None:
                continue
            start = zlib.crc32(b"null:" if doc is None else b"%d:" % doc)
            for run, n in Counter(RUN.findall(raw.to_pybytes().translate(LOWER))).items():
                if len(run) < LEAST_CHARS:
                    continue
                h = zlib.crc32(run, start)
                if h % SPOILT == 0:
                    word = run.decode()
                    at = h % len(word)
                    run = (word[:at] + word[at + 1 :]).encode()
                held[run] += n
        if len(held) >= HELD:
            yield out()
            held.clear()
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    with arrow_batches(docs.sparkSession, 1000):
        return written(docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")


def grams(found: DataFrame, frequent: int = FREQUENT, most: int = MOST) -> DataFrame:
    """(word, size, at, gram, lists): a word's grams, one from each place, with the number of places that have the gram.

    Grams grow by a character while they are frequent: in each round those that are stay, the others are done.
    """
    spark, done, used = found.sparkSession, [], []
    size = F.length("word")
    rows = found.select("word", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    for length in range(2, most + 1):
        # a gram that reaches the word's end has END there and doesn't grow
        text = F.expr(f"substring(concat(word, '{END}'), at + 1, {length})")
        rows = rows.withColumn("gram", text)
        counts = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("lists")), "grams")
        used.append(counts)
        whole = (F.col("at") + length > F.col("size")) if length < most else F.lit(True)
        often = counts.where(F.col("lists") > frequent)
        often = F.broadcast(often) if often.count() <= BROADCAST_GRAMS else often
        met = rows.join(often, "gram", "left")
        # the lists of frequent grams that can't grow count whole, those of others are FREQUENT at most
        here = written(met.select("word", "size", "at", "gram", F.coalesce("lists", F.lit(0)).alias("lists"), (whole | F.col("lists").isNull()).alias("done")), "placed")
        used.append(here)
        done.append(here.where("done").drop("done"))
        rows = here.where("NOT done").select("word", "size", "at")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = written(out, "decomposed")
    for x in used:
        remove(spark, x)
    return out


def near_pairs(found: DataFrame, frequent: int = FREQUENT, most: int = MOST) -> DataFrame:
    """(a, b): the pairs of words that differ by one character inserted, deleted or replaced, each once."""
    spark = found.sparkSession
    all_grams = grams(found, frequent, most)
    end = lambda g: g["at"] + F.length(g["gram"]) - 1
    by_word = all_grams.groupBy("word", "size").agg(F.array_sort(F.collect_list(F.struct("lists", "at", "gram"))).alias("grams"))
    # an edit changes, or stands before, the character at a place from 0 to the end mark's; grams over it are touched. One put in
    # before a gram's first character leaves it whole, but counts here all the same
    touched = F.array_max(F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: F.size(F.filter("grams", lambda g: (g["at"] <= i) & (end(g) >= i)))))
    few = by_word.select("word", "size", F.explode(F.slice(F.col("grams"), F.lit(1), touched + 1)).alias("g")).select("word", "size", "g.at", "g.gram")
    # the other word is as long or longer by one; the gram stands where it did, or one further if the edit came before it
    places = F.array(F.struct(F.col("size").alias("size"), F.col("at").alias("at")), F.struct((F.col("size") + 1).alias("size"), F.col("at").alias("at")), F.struct((F.col("size") + 1).alias("size"), (F.col("at") + 1).alias("at")))
    index = few.select(F.col("word").alias("a"), "gram", F.explode(places).alias("p")).select("a", "gram", "p.size", "p.at")
    other = all_grams.select(F.col("word").alias("b"), "gram", "size", "at")
    merged = index.join(other, ["gram", "size", "at"]).where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    out = written(merged.where(F.levenshtein("a", "b", 1) == 1), "near")
    remove(spark, all_grams)
    return out


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of rows (word, form), form null at the ends: forms followed to the last.

    A form occurs RATIO times as often as its word, so the largest number bounds the steps; each round doubles them.
    """
    steps = max(1, math.floor(math.log(max(most, LEAST_COUNT) / LEAST_COUNT, RATIO) + 1e-9))
    now = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        nxt = written(now.alias("x").join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root").select("word", F.col("next").alias("root")), "roots")
        now = nxt
    return now


def variants(docs: DataFrame) -> DataFrame:
    """Per word of all texts: word, form, root, n, n_near and form_n."""
    found = words(docs)
    pairs = near_pairs(found)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("b").alias("word"))).alias("best")
    each = both.join(found.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = found.join(each, "word", "left")
    enough = -F.col("best.minus") >= RATIO * F.col("n")
    rows = written(rows.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    remove(docs.sparkSession, pairs)
    remove(docs.sparkSession, found)
    most = rows.agg(F.max("n")).first()[0] or 0
    return rows.join(roots(rows, most), "word").select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
r AS (SELECT id, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') AS run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= {LEAST_CHARS} GROUP BY 1, 2),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(id || ':' || run)), '..')]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS h FROM r, crc),
s AS (SELECT CASE WHEN h % {SPOILT} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
b AS (SELECT p.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS other, max(v.n) AS most FROM p JOIN v ON v.word = p.other GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * v.n THEN other END AS form, CASE WHEN most >= {RATIO} * v.n THEN most END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word JOIN f AS g ON g.word = w.root WHERE g.form IS NULL
"""
