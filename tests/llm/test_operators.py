"""The dealt operators against plain versions, exact round trips and their defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetweave.llm import chat, components, decontaminate, dom, extract, fingerprint, labelled_pages, linededup, mixing, neardup, quality, queries, sharding, shingles, tokenfile
from tests.llm import brute
from tests.oracle import DATA, check

ODD = [(1, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "two words"), (None, "a b c d e f g"), (5, "x" * 5000 + " y" * 20000), (6, "ÀÉ ß 日本 \U0001f600"), (7, "a b c d e f g"), (8, "A B C D E F G"), (-1, "\\ <|end|> [INST]")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, ties, empty and long texts, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s" if k % 2 else None, 1, "kept", 7) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, copy int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_shingles_equal_plain_ones():
    texts = [t for _, t in ODD] + ["a b c a b c", "a\x0bB\x0cc\x1cd"]
    for width in (1, 2, 5):
        hashes, at = shingles.shingle_hashes(pa.array(texts, pa.string()), width)
        assert [len(s) for s in shingles.distinct_sets(hashes, at)] == [len(brute.shingles(t, width)) for t in texts]


def test_step_borders_do_not_matter(monkeypatch):
    text = pa.array(["word%d " % (k % 97) * 50 for k in range(40)])
    whole = shingles.shingle_hashes(text, 5)
    monkeypatch.setattr(shingles, "STEP", 64)
    parts = shingles.shingle_hashes(text, 5)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_sharding_is_even_and_moves_little():
    before = sharding.lookup_table(sharding.shard_names(24), 2503)
    after = sharding.lookup_table(sharding.shard_names(25), 2503)
    sizes = np.bincount(before)
    assert sizes.max() - sizes.min() <= 1
    assert np.mean([a != b for a, b in zip(before, after, strict=True)]) < 0.2
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(["a"], 100)


def test_sharding_defined_cases(spark, odd):
    got = sharding.place(odd).collect()
    assert len(got) == len(ODD) and all(isinstance(r.shard, int) for r in got)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.place(odd.limit(0)).count() == 0


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_fingerprints_estimate_likeness(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.edited_report(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        errors += [abs(got[i].near_edited - brute.jaccard(brute.shingles(t, 5), brute.shingles(e, 5))), abs(got[i].near_next - brute.jaccard(brute.shingles(t, 5), brute.shingles(n, 5)))]
    assert np.mean(errors) < 0.02 and max(errors) < 0.15


def test_fingerprints_defined_cases(spark, odd):
    got = fingerprint.edited_report(odd).collect()
    assert len(got) == len(ODD)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {""}
    assert fingerprint.edited_report(odd.limit(0)).count() == 0
    one = fingerprint.edited_report(odd.where("doc_id = 7")).first()
    assert one.near_next == 1.0
    same = fingerprint.fingerprints(odd.where("doc_id in (7, 8)")).select("fingerprint").distinct()
    assert same.count() == 1
    pair = spark.createDataFrame([("", ""), ("", one.fingerprint)], "a string, b string")
    assert [r.x for r in pair.select(fingerprint.likeness_column("a", "b").alias("x")).collect()] == [1.0, 0.0]


def test_fingerprints_of_ids_beyond_doubles(spark):
    rows = [(2**60 + k, f"text number {k} of some words") for k in range(300)]
    got = fingerprint.edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    text = {i: t for i, t in rows}
    for r in got:
        t, n = text[r.doc_id], text[r.doc_id + 1 if r.doc_id + 1 in text else 2**60]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, width):
    wanted = brute.near_components([(r.doc_id, r.text) for r in docs.collect()], width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width).collect()}
    assert got == wanted


@pytest.mark.parametrize(("n", "words", "low", "high"), [(300, 60, 0, 4), (1500, 100, 4, 6)])
def test_near_duplicates_in_a_dense_group(spark, monkeypatch, n, words, low, high):
    monkeypatch.setattr(neardup, "CHUNK", 256)
    r = random.Random(5)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(low, high)):
            w[r.randrange(words)] = f"v{r.randrange(100_000)}"
        rows.append((k, " ".join(w)))
    wanted = brute.near_components(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted


def test_near_duplicates_of_other_likeness(spark, docs):
    """Links at a likeness of a half and of 0.9; thresholds that the search isn't built for are refused."""
    some = [(r.doc_id, r.text) for r in docs.collect()]
    for least in (50, 90):
        rows = [*some, (10_001, "a b c d e f"), (10_002, "a b c d x y z"), (10_003, " ".join(f"w{k}" for k in range(60))), (10_004, " ".join(f"w{k}" for k in range(57)))]
        wanted = brute.near_components(rows, 2, least)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, least).collect()}
        assert got == wanted
    with pytest.raises(ValueError, match="likeness"):
        neardup.near_duplicates(docs, 2, 40)


def test_near_duplicates_of_a_document_of_several_texts(spark):
    word = lambda k: " ".join(f"{k}w{i}" for i in range(20))
    rows = [(1, word("a")), (1, word("b")), (1, word("c")), (2, word("a")), (3, word("b") + " more"), (4, word("c")), (0, word("d")), (1, word("b")), (1, None)]
    got = neardup.near_duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)}


def test_sketches_estimate_the_difference():
    r = np.random.default_rng(3)
    for n in (50, 500, 2040, 9000):
        base = r.integers(0, 2**63, n, np.int64).astype(np.uint64)
        sets = [base] + [np.concatenate([base[: n - k], r.integers(0, 2**63, k, np.int64).astype(np.uint64)]) for k in (n // 10, n // 9 - 2, n // 3)]
        sketch = neardup.sketches(sets).view(np.uint64)
        a, b, apart = neardup.close(np.zeros(3, int), np.array([1, 2, 3]), np.full(4, n), sketch, 80, 100)
        assert b.tolist() == [1, 2] and abs(apart[0] - 0.1) < 0.03


def test_spanning_forest_is_least():
    r = np.random.default_rng(4)
    for _ in range(20):
        u, v, cost = r.integers(0, 12, 30), r.integers(0, 12, 30), r.random(30)
        up, wanted = {k: k for k in range(12)}, set()

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for e in np.argsort(cost):
            if root(u[e]) != root(v[e]):
                up[root(u[e])] = root(v[e])
                wanted.add(int(e))
        assert set(neardup.spanning(u, v, cost).tolist()) == wanted


def test_near_duplicates_of_a_hub(spark):
    """1,500 copies of one text that are linked with it only: more than the forest's sweeps look at."""
    r = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1501):
        words = list(base)
        for k in r.sample(range(1, 399, 2), 20):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    sets = [brute.shingles(t, 2) for _, t in rows]
    assert all(brute.jaccard(sets[0], s) >= 0.8 for s in sets) and all(brute.jaccard(x, y) < 0.8 for x, y in zip(sets[1:], sets[2:]))
    got = neardup.near_duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1501 and {r.component_id for r in got} == {0}


def test_near_duplicates_defined_cases(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicate_report(odd).collect()]
    assert len(got) == len(ODD)
    assert (7, 6, 7, True) in got and (8, 6, 7, False) in got and (None, 6, None, True) in got and (2, 0, 2, True) in got
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    assert neardup.keep_one(odd, 2).columns == odd.columns and neardup.keep_one(odd, 2).count() == len(ODD) - 1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component_id for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def test_parse_drops_raw_elements_only():
    text = lambda page: " ".join(p for _, p, _ in dom.parse(page).pieces).split()
    assert text("<p>a <math><mi>x</mi></math> b<noscript>c</noscript><p>d<svg>e<p>f<select>g") == list("axbcdefg")
    assert text("<p>" + "\u0130" * 40 + "</p><SCRIPT>x</Script ><p>kept</p><p>too</p>") == ["\u0130" * 40, "kept", "too"]
    assert text("<title>a</titles></title>b<style/>c<script>d") == ["b", "c"]


@pytest.mark.parametrize("attribute", ["", ' style="border:none"', ' style="text-decoration:none"', ' style="list-style: none"', ' hidden=""', ' style="display:none"'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_styles_take_no_text(tag, attribute):
    words = "A first paragraph of the article with enough words to be one. " * 3
    page = f"<html><body><nav class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><{tag} class=content{attribute}><h1>Title</h1><p>{words}</p><ul{attribute}><li>{words}</li></ul><p>{'\u0130' * 40}</p><script>x</script><p>{words}</p></{tag}><footer class=footer>Copyright</footer></body></html>"
    wanted = f"Title {words} {words} {'\u0130' * 40} {words}".split()
    assert extract.extracted([page], extract.default_model())[0].split() == wanted


def test_pages_held_out():
    pages = labelled_pages.labelled_pages(120, seed=77)
    model = extract.default_model()
    trees = [dom.parse(p) for p in pages]
    forest, label = extract.Forest(trees), extract.truth(trees)
    assert ((forest.marginals(*model)[0] > 0.5) == label).mean() > 0.97


def test_marginals_equal_enumeration():
    tree = dom.parse("<div><p>a</p><nav><a>b</a></nav></div>")
    forest = extract.Forest([tree])
    r = np.random.default_rng(1)
    weight, edge = r.normal(size=extract.N), r.normal(size=(extract.KINDS, 2, 2))
    n = len(tree.tag)
    score, total = forest.potentials(weight), np.zeros(n)
    z = 0.0
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        p = np.exp(sum(score[k] * y[k] for k in range(n)) + sum(edge[forest.kind[k], y[tree.parent[k]], y[k]] for k in range(1, n)))
        z += p
        total += p * np.array(y)
    assert np.allclose(forest.marginals(weight, edge)[0], total / z)


def test_pages_defined_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<" * 500 + 'a="' * 500), (4, "u", "<div>" * 3000 + "x"), (5, "u", "<script>never closed <p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract.page_report(df).collect()
    assert len(got) == 5 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert extract.page_report(df.limit(0)).count() == 0
    page = "<html><body><nav class=menu><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>One <b>two</b>three<br>four.</p><aside class=ad>Buy this now.</aside><p>On.</article><footer>&copy; us</footer>"
    assert extract.extracted([page], extract.default_model()) == ["Title & more One twothree four. On."]


def test_page_texts_are_the_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in extract.page_report(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())


def test_mixing_meets_its_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "b").otherwise("c").alias("source"))
    got = {r.source: r["count"] for r in mixing.replicate(df, {"a": 1.0, "b": 1.0, "c": 0.0}, total=20_000).groupBy("source").count().collect()}
    assert set(got) == {"a", "b"} and all(abs(n - 10_000) < 1_000 for n in got.values())


def test_mixing_defined_cases(spark, odd):
    got = mixing.replicate(odd, {None: 2.0, "s": 1.0}, total=60).collect()
    assert {r.source for r in got} == {None, "s"} and min(r.copy for r in got) == 1
    assert mixing.replicate(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="most"):
        mixing.replicate(odd, {"s": 1.0}, total=10**6)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns with the names that the operators make for themselves."""
    names = ["_source", "_chances", "_count", "_flags", "_id", "_text", "_score", "score", "chances", "draws", "count", "name", "own", "body", "flags", "dropped", "hit", "_hit", "n_lines", "kept_text", "slot", "rate"]
    rows = [(k, f"Some text of {k % 3} and more words\nsame line", "en", ["s", "t", None][k % 3], 1) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})


def carried(df, but=()):
    """Whether each column made by clashing() still has its values."""
    names = [c for c in df.columns if c not in {"doc_id", "text", "lang", "source", "n_chars", *but}]
    return len(names) == 22 - len(set(but) & {"n_lines", "kept_text", "slot"}) and all(r[n] == f"{n}{r.doc_id}" for r in df.collect() for n in names)


def test_columns_pass_through_whatever_their_names(spark, clashing):
    assert carried(mixing.replicate(clashing), ("copy", "shuffle_key"))
    assert mixing.replicate(clashing).columns == [*clashing.columns, "copy", "shuffle_key"]
    lines = linededup.dedup_lines(clashing)
    assert carried(lines, ("n_lines", "n_dropped", "kept_text")) and len(lines.columns) == len(set(lines.columns)) == len(clashing.columns) + 1
    assert {r.n_dropped for r in lines.collect()} == {2}
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(clashing, labels).columns == clashing.columns and carried(quality.keep_good(clashing, labels))
    assert carried(sharding.place(clashing), ("slot", "shard"))
    clean = decontaminate.keep_clean(clashing, spark.createDataFrame([(1, "text of 1 and more")], "item_id long, text string"))
    assert clean.columns == clashing.columns and clean.count() == 20 and carried(clean)
    one = neardup.keep_one(clashing)
    assert one.columns == clashing.columns and one.count() == 3 and carried(one)


def test_mixing_repeats_a_tiny_source_as_often_as_its_weight_asks(spark):
    df = spark.range(1_000_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "tiny").otherwise("large").alias("source"))
    rate = {r.source: r.rate for r in mixing.rates(df).collect()}["tiny"]
    n = mixing.replicate(df).where("source = 'tiny'").count()
    assert rate > mixing.MOST_RATE and abs(n - rate) < 6 * rate**0.5


def test_conversations_equal_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.conversation_report(df).collect()}
    assert got == brute.conversations(rows)


def test_chat_layouts(spark):
    payloads = [
        '{"prompt": "p", "completion": "c", "extra": {"x": [1]}}', '{"instruction": "i", "input": "j", "output": "o"}', '{"instruction": "i", "output": "o", "system": "s"}', '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}',
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"messages": []}', '{"what": 1}', "not json", None, '{"data": {"prompt": "p", "completion": "c"}}',
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string")
    got = {}
    for r in sorted(chat.canonical_turns(df).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got[0] == [("completion", "user", "p"), ("completion", "assistant", "c")]
    assert got[1] == [("instruction", "user", "i\n\nj"), ("instruction", "assistant", "o")]
    assert got[2][0] == ("instruction", "system", "s") and got[3][1] == ("messages", "assistant", "")
    assert got[4] == [("shared", "user", "h"), ("shared", "assistant", "g")]
    assert 5 not in got and [got[k][0][0] for k in (6, 7, 8)] == [None] * 3 and got[9][0][0] == "nested"


def test_chat_escapes_round_trip():
    r = random.Random(2)
    bits = ["<", "|", ">", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<|end|>\n", "\n", "a", "<|user|>", "<<SYS>>", "<</SYS>>"]
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "<|x", "a|", "|>\n", ""]), "".join(r.choices(bits, k=r.randint(0, 8)))) for _ in range(3)]
        text = "".join(chat.formatted_turn(*t)[0] for t in turns)
        assert chat.read_turns(text) == turns
        assert "[INST]" not in text and "</s>" not in text


def test_chat_defined_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_report(df).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 1 and set(got) == {1, None, -7}
    assert chat.conversation_report(df.limit(0)).count() == 1


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(r.choice([1, 3, 5, 8, 12, 20, 40, 90])))) for k in range(60)] + [(60, None), (61, ""), (62, "one two")]
    docs = []
    for k in range(80):
        body = [word() for _ in range(r.choice([3, 50, 400, 2000]))]
        if k % 2:
            item = (items[k % 60][1] or "").split()
            if k % 4 == 3 and len(item) > 15:
                item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(body))
            body[at:at] = item
        docs.append((k, " ".join(body)))
    docs += [(80, None), (81, ""), (82, "One TWO")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == brute.contained(docs, items)


def test_decontamination_defined_cases(spark, odd):
    items = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "zz")], "item_id long, text string")
    assert {tuple(x)[:2] for x in decontaminate.contaminated(odd, items).collect()} == {(None, 1), (7, 1), (8, 1)}
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0 and decontaminate.contaminated(odd.limit(0), items).count() == 0
    clean = decontaminate.keep_clean(odd, items)
    assert clean.count() == len(ODD) - 3 and clean.columns == odd.columns


def test_decontamination_in_blocks_of_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    item = lambda k: " ".join(f"i{k}w{j}" for j in range(8))
    items = [(k, item(k % 6)) for k in range(40)] + [(0, item(0)), (50, item(1).upper())]
    docs = [(k, f"before {item(k)} after") for k in range(8)] + [(9, item(2) + " " + item(3))]
    rows, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in decontaminate.contaminated(rows, items_df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.contained(docs, items)
    index = decontaminate.Items([i for i, _ in items], [t for _, t in items])
    assert len(index.sets) == 6 and sum(map(len, index.ids)) == len(items)
    assert decontaminate.keep_clean(rows, items_df).count() == 2


def test_clean_rows_stay_whatever_their_ids(spark):
    item = "one two three four five six seven"
    rows = [(None, f"so {item} it goes"), (None, "a clean text of no id at all"), (None, None), (1, item), (1, "another clean text of the same id"), (2, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = decontaminate.keep_clean(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted(map(str, (tuple(r) for r in clean.collect()))) == sorted(map(str, [rows[1], rows[2], rows[4]]))


def test_quality_held_out(spark):
    folder = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality_report(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert [bool(zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id] == got.held_out.tolist()


def test_hinge_fit_separates():
    r = np.random.default_rng(0)
    label = np.arange(200) % 2
    rows = [(np.array([0 if y else 1, 2 + int(r.integers(5))]), np.ones(2)) for y in label]
    weight, bias = quality.hinge_fit(rows, np.where(label == 1, 1, -1), 10)
    assert all((weight[f] @ v + bias > 0) == (y == 1) for (f, v), y in zip(rows, label, strict=True))


def test_class_counts_are_the_documents(spark):
    texts = ["Aa bb bb", "Aa bb bb", "", "zz! 12", "bb cc dd", None, "Aa"]
    rows = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "doc_id long, text string, label int")
    table, bad, good = quality.class_counts(rows.repartition(3))
    wanted = np.zeros((2, quality.FEATURES))
    for k, f in enumerate(quality.features(pa.array(texts, pa.large_string()))):
        assert len(set(f.tolist())) == len(f)
        for i in f:
            wanted[k % 2][i] += 1
    assert (bad, good) == (4, 3) and (table == wanted).all()


def test_hinge_fit_is_the_optimum():
    r = np.random.default_rng(1)
    label = r.integers(0, 2, 60)
    rows = [(np.sort(r.choice(15, 5, replace=False)), r.random(5) + y * (r.random(5) > 0.6)) for y in label]
    sign = np.where(label == 1, 1, -1)
    weight, bias = quality.hinge_fit(rows, sign, 15, epochs=2000, enough=1e-9)
    top = np.array([quality.PENALTY * len(sign) / (2 * (sign == s).sum()) for s in sign])
    loss = np.array([max(0.0, 1 - s * (weight[f] @ v + bias)) for (f, v), s in zip(rows, sign, strict=True)])
    primal = 0.5 * (weight @ weight + bias**2) + top @ loss
    # no small move makes it better, in any direction
    for _ in range(300):
        step, shift = r.normal(size=15) * 1e-3, r.normal() * 1e-3
        other = np.array([max(0.0, 1 - s * ((weight + step)[f] @ v + bias + shift)) for (f, v), s in zip(rows, sign, strict=True)])
        assert 0.5 * ((weight + step) @ (weight + step) + (bias + shift) ** 2) + top @ other >= primal - 1e-7


def test_scores_equal_a_plain_evaluation(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and not held(r.doc_id)}
    on = {i: quality.features(pa.array([t], pa.large_string()))[0] for i, t in texts.items()}
    table = np.zeros((2, quality.FEATURES))
    for i, y in label.items():
        table[y][on[i]] += 1
    good = sum(label.values())
    ratio = np.log((table[1] + 1) / (good + 2)) - np.log((table[0] + 1) / (len(label) - good + 2))
    ratio[table.sum(axis=0) == 0] = 0
    ids = sorted(label)
    model = quality.fit_rows(ratio, [on[i] for i in ids], np.array([label[i] for i in ids]))
    for r in quality.quality_report(docs, labels).collect():
        v = ratio[on[r.doc_id]]
        margin = sum(model.weight[on[r.doc_id]]) / max(1.0, float(v @ v) ** 0.5) + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-6
        assert r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id)


def test_quality_defined_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_report(odd, none).collect()
    assert len(got) == len(ODD) and {round(r.score, 3) for r in got} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (4, 0, 0), (4, 1, 0), (8, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, some)
    scores = odd.select(quality.score(F.col("text"), model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scores)
    assert quality.keep_good(odd, some).columns == odd.columns and quality.quality_report(odd.limit(0), some).count() == 0


def tokenizer() -> str:
    public = pytest.importorskip("public_tokenizers")
    return Path(public.path("word_bpe_49k.json")).read_text()


def test_token_files_equal_whole_encoding(spark, docs):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_str(tokenizer()), 0
    got = {r.doc_id: r for r in tokenfile.stored_report(docs, tokenizer()).collect()}
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_ascend(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    tokenfile.write_tokens(docs.orderBy(F.xxhash64("doc_id")), path, tokenizer())
    ids = []
    for f in sorted((tmp_path / "ids").glob("part-*.orc")):
        ids += [r.doc_id for r in spark.read.orc(str(f)).collect()]
    assert ids == sorted(r.doc_id for r in docs.collect())


def test_encoder_on_hard_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(tokenizer())
    hard = ["á b", "x ́y", " a b", "İstanbul ǅ ß", "don't we'll I'VE it's", "<|endoftext|> a<|startoftext|>b", "", None, "  ", "12 3４5", "日本語 テスト", "ﬁ ½", "a\x00b", "ᾳ Σ ΑΣ ΑΣ.", "a≮ b", "É. É́ Ab.Cd ab... 'a' _c_ ²x"]
    for texts in (hard, [*hard, "a\x1cb"]):
        ids, at = tokenfile.Encoder(tokenizer()).ids(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids + [1]


def test_start_of_repeated_ids_is_that_of_the_files(spark, tmp_path):
    rows = [(1, "a much longer text than the other one"), (1, "zed"), (0, "first"), (1, "zed"), (2, "b")] + [(7, f"text {k} " * (k % 5)) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "ids")
    tokenfile.write_tokens(df, path, tokenizer())
    ids, wanted = [], []
    for f in sorted((tmp_path / "ids").glob("part-*.orc")):
        for r in spark.read.orc(str(f)).collect():
            wanted.append((r.doc_id, len(ids), len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())))
            ids += r.ids
    assert [w[0] for w in wanted] == sorted(i for i, _ in rows)
    assert sorted(map(tuple, tokenfile.token_report(tokenfile.read_tokens(spark, path)).collect())) == sorted(wanted)


def test_encoder_memory_lets_old_units_go(monkeypatch):
    monkeypatch.setattr(tokenfile.Memory, "MOST", 50)
    encoder, whole = tokenfile.Encoder(tokenizer()), tokenfile.Encoder(tokenizer())
    whole.pieces = False
    r = random.Random(8)
    for k in range(12):
        texts = pa.array([" ".join(f"word{r.randrange(80)}x{'.' * r.randrange(3)}" for _ in range(30)) for _ in range(4)])
        for a, b in zip(encoder.ids(texts), whole.ids(texts), strict=True):
            assert a.tolist() == b.tolist()
    assert len(encoder.memory.used) < 200


def test_token_files_defined_cases(spark, odd, tmp_path):
    got = sorted(tokenfile.stored_report(odd, tokenizer()).collect(), key=lambda r: r.start)
    assert len(got) == len(ODD) and got[0].doc_id is None and [r.n_tokens for r in got if r.doc_id == 1] == [1, 1]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert tokenfile.stored_report(odd.limit(0), tokenizer()).count() == 0
    path = str(tmp_path / "ids")
    tokenfile.write_tokens(odd, path, tokenizer())
    stored = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: (r.piece, r.place))
    start = 0
    for r, x in zip(stored, got, strict=True):
        assert (x.doc_id, x.start, x.n_tokens) == (r.doc_id, start, len(r.ids))
        start += len(r.ids)
    plan = tokenfile.read_tokens(spark, path).where("doc_id = 7")
    assert plan.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_defined_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "x\ny"), (3, "x"), (3, "x\n"), (None, None)] + [(k, " x\t\nQ\n") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(0))
    got = linededup.line_report(df).collect()
    assert len(got) == len(rows)
    assert all(r.n_dropped == 1 for r in got if r.n_lines == 3) and sum(r.n_dropped for r in got) == 12
    assert linededup.line_report(df.limit(0)).count() == 0


def test_line_runs_over_batches(spark):
    runs = linededup.LineRuns(spark, documents=3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, f"same\nown {k}")], "doc_id long, text string"))
    assert runs.settled().count() == 1 and [len(x) for x in runs.levels] == [1, 0, 1]
    # by the fourth batch the key was settled, so the fifth run is without it
    assert runs.done.rows().count() == 1 and runs.levels[0][0].rows().count() == 1
    with linededup.sorted_scans(spark):
        for plan in (runs.counts(spark.createDataFrame([(9, "x\ny")], "doc_id long, text string")), linededup.merged(runs.done.rows(), runs.levels[2][0].rows())):
            text = plan._jdf.queryExecution().executedPlan().toString()
            side = text[text.index("SortMergeJoin") :]
            assert side.count("line_run_") == side.count("Bucketed: true") and side.count("Exchange") == (1 if "LeftOuter" in text else 0) == side.count("Sort [")
    new = spark.createDataFrame([(9, " SAME \nother")], "doc_id long, text string")
    assert linededup.drop_lines(new, runs).first().kept_text == "other"
    many = spark.createDataFrame([(1, "same\na\nsame\nsame\nb"), (1, "same"), (2, "c\nsame"), (1, "same\na\nsame\nsame\nb")], "doc_id long, text string")
    assert sorted((r.n_lines, r.n_dropped, r.kept_text) for r in linededup.drop_lines(many, runs).collect()) == [(1, 1, ""), (2, 1, "c"), (5, 3, "a\nb"), (5, 3, "a\nb")]
    runs.remove()
