"""The operators for training data against brute force, on odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib
from xml.etree import ElementTree

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from weftline.llm import common, divergence, hash_tree, packing, pii, separators, simhash, style_tree, substrings, templates, temporal_urls
from weftline.llm.tokens import WordEncoder, default_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard int"
WORDS = "alpha beta gamma delta the of and to in a quick brown fox jumps over lazy dog é ü 12 3.5 Tom".split()


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and white space."""
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(k))
    shared = text(45)
    rows = []
    for k in range(n):
        t = text(r.choice([0, 1, 2, 5, 30, 90, 200]))
        if k % 5 == 0 and rows:
            t = r.choice(rows)[1]
        elif k % 7 == 0:
            t = f"{t} {shared} {text(10)}"
        rows.append((k, t, r.choice(["en", "de", None]), f"s{k % 3}", len(t or ""), "clash", 1))
    rows += [(n, None, "en", None, None, None, None), (n + 1, "", None, "s", 0, "", 0), (n + 2, " \n\t ", "en", "s", 4, "", 0), (n + 3, text(30_000), "en", "s", 1, "", 0), (None, text(40), "en", "s", 1, "", 0), rows[3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


BENCH = "item_id long, text string, doc_id string"


def test_empty_tables_give_no_rows(spark, empty):
    items = spark.createDataFrame([], BENCH)
    assert hash_tree.assign(empty).count() == 0
    assert divergence.judge(empty).count() == 0 and divergence.keep_good(empty).count() == 0
    assert substrings.dedup_substrings(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert pii.find_personal(empty).count() == 0 and pii.redact_documents(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert separators.count_tokens(separators.write_blocks(empty)).count() == 0
    assert templates.contaminated(empty, items).count() == 0 and templates.drop_contaminated(empty, items).count() == 0
    assert style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    captures = spark.createDataFrame([], "url string, fetched_at long, host string")
    assert temporal_urls.filter_urls(captures, spark.createDataFrame([], temporal_urls.LIST_COLUMNS)).count() == 0


# --- 1


def test_templates_find_copies_and_other_parameters(spark):
    item = "Tom has 5 apples and buys 3 km of rope for his old friend Mary. How many apples does Tom have after 5 days in total?"
    other = "x y z. Anna has 7 apples and buys 9 miles of rope for his old friend Lucy. How many apples does Anna have after 7 days in total? bye"
    mixed = other.replace("after 7 days", "after 8 hours").replace("Lucy", "Anna").replace("Anna have", "Bob have")
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "short", None), (4, "one two three four five six seven eight", "")], BENCH)
    rows = [(1, other), (2, f"{item} {item}"), (3, None), (4, "has apples and buys rope"), (5, mixed), (6, "a " * 5000 + "one two three four five six seven eight"), (1, other), (None, item)]
    for limit in (300_000, 0):
        got = {(r.doc_id, r.item_id): r for r in templates.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items, {"consistency": 0.95}, broadcast_rows=limit).collect()}
        assert set(got) == {(1, 1), (2, 1), (6, 4), (None, 1)}
        assert got[2, 1].exact and not got[1, 1].exact and got[1, 1].consistency == 1 and got[1, 1].n_slots > 3
    kept = templates.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items, {"consistency": 0.95})
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 5]  # the row without doc_id has an item as well


def test_templates_find_items_with_words_put_in_or_left_out(spark):
    item = "in a small town by the sea the old baker told Maria that his sweet bread costs more than 1200 coins because flour and salt became rare"
    rows = [(1, item.replace("Maria", "Maria Lopez")), (2, item.replace("1200", "1 200")), (3, item.replace("sweet ", "")), (4, item.replace("sweet bread", "sweet and brown bread")), (5, item), (6, " ".join(item.split()[:9]))]
    items = spark.createDataFrame([(1, item, ""), (2, item.replace("Maria", "Eva Lopez"), "")], BENCH)
    got = {(r.doc_id, r.item_id): r for r in templates.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(d, i) for d in range(1, 6) for i in (1, 2)}
    assert got[5, 1].exact and got[5, 1].coverage == 1 and got[4, 1].coverage >= 0.9 and got[1, 1].doc_start == 0


def test_templates_find_items_without_windows(spark):
    texts = ["What is the capital of France?", "3 + 5 + 7 = 15, 2 + 4 + 6 = 12", "法国的首都是哪一个城市", "Why so?"]
    items = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], BENCH)
    rows = [(k, f"before this. {t} And after") for k, t in enumerate(texts)] + [(9, "3 + 5 + 7 = 15, 2 + 4 + 6 = 13. What is the name of it? 法国的首都 so why")]
    rows[2] = (2, "请问法国的首都是哪一个城市呢")
    got = {(r.doc_id, r.item_id): r for r in templates.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(k, k) for k in range(4)} and all(r.exact for r in got.values())


def template(text: str) -> list[str]:
    t = regex.sub("[\x01\x02]", " ", text or "")
    names = "(?<=[\\p{L}\\p{N},;] )(?=\\p{Lu}\\p{L})|\\b(?=(?:" + "|".join(templates.GIVEN_NAMES) + ")\\b)"
    if re.search("[0-9]", t):
        t = regex.sub("([0-9]) ?(" + "|".join(sorted(templates.UNITS, key=len, reverse=True)) + ")(?![\\p{L}\\p{N}])", "\\1 \x02\\2", t)
    return regex.findall("[\x01\x02]?(?:[0-9]+(?:[.,][0-9]+)*|[\\p{L}\\p{M}]+)", regex.sub(names, "\x01", t).lower())


def kind(w: str) -> str:
    return "#" if w[0] in "0123456789" else {"\x01": "@", "\x02": "%"}.get(w[0], w)


def contaminated(doc: list[str], item: list[str]) -> tuple | None:
    """(doc_start, n_matched, n_windows, coverage, n_slots, consistency, exact) of the best line or band, by all pairs of windows."""
    w, best = 8, None
    good = [a for a in range(len(item) - w + 1) if sum(kind(x) not in "#@%" for x in item[a : a + w]) >= 5]
    lines = collections.defaultdict(set)
    for a in good:
        for place in range(len(doc) - w + 1):
            if list(map(kind, item[a : a + w])) == list(map(kind, doc[place : place + w])):
                d = place - a
                for g in ((0, d), (1, d // 8), (1, d // 8 + 1)):
                    lines[g].add((a, d))
    cover = lambda at: len({a + k for a in at for k in range(w)})
    for (wide, _), hits in lines.items():
        at, ds = {a for a, _ in hits}, {d for _, d in hits}
        if wide and len(ds) < 2:
            continue
        span = cover(at) - (w - 1)
        share = max(len(at) / len(good), span / (cover(good) - (w - 1)))
        if share < 0.5 or max(len(at), span) < min(3, len(good)):
            continue
        spots = {(a + k, a + d + k) for a, d in hits for k in range(w)}
        if wide:
            spots = {x for x in spots if not any(y[0] == x[0] and y[1] < x[1] for y in spots)}
            spots = {x for x in spots if not any(y[1] == x[1] and y[0] < x[0] for y in spots)}
        slots = {(item[i], doc[d]) for i, d in spots if kind(item[i]) in "#@%"}
        even = (len({x for x, _ in slots}) + len({y for _, y in slots})) / (2 * len(slots)) if slots else 1.0
        row = (min(a + d for a, d in hits), len(at), len(good), round(share, 9), len(slots), round(even, 9), all(x == y for x, y in slots))
        rank = (len(at), even, -wide, -min(ds))
        if even >= 0.8 and (best is None or rank > best[0]):
            best = (rank, row)
    return best and best[1]


def test_templates_match_brute_force(spark):
    r = random.Random(23)
    pool = "has apples and buys rope for old friend many does have after total the market where people sell 3 7 12 km kg Tom Anna Lucy".split()
    text = lambda n: " ".join(r.choice(pool) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    items = [(k, text(r.choice([12, 20, 30]))) for k in range(8)] + [(8, None), (None, text(25))]
    rows = []
    for k in range(50):
        words = r.choice(items)[1]
        words = (words or text(20)).split()
        for _ in range(r.randint(0, 3)):
            at, act = r.randrange(len(words)), r.random()
            if act < 0.3:
                words.insert(at, r.choice(pool))
            elif act < 0.5 and len(words) > 9:
                del words[at]
            else:
                words[at] = r.choice(["3", "99", "Anna", "Eva", words[at], words[at]])
        rows.append((k, " ".join([text(r.randint(0, 12)), *words[r.choice([0, 0, 4]) :], text(r.randint(0, 12))])))
    rows += [(60, None), (61, ""), (None, items[0][1])]
    want = {}
    for d, t in rows:
        for i, x in items:
            if x and (found := contaminated(template(t), template(x))):
                want[d, i] = found
    assert len(want) > 20 and any(not v[6] for v in want.values())
    dfs = (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, x, "") for i, x in items], BENCH))
    for limit in (templates.FILTER_HASHES, 0):  # looked up inside arrays, then by a join alone
        old, templates.FILTER_HASHES = templates.FILTER_HASHES, limit
        try:
            got = {(x.doc_id, x.item_id): (x.doc_start, x.n_matched, x.n_windows, round(x.coverage, 9), x.n_slots, round(x.consistency, 9), x.exact) for x in templates.contaminated(*dfs).collect()}
        finally:
            templates.FILTER_HASHES = old
        assert got == want


def test_templates_stay_on_the_jvm(spark, docs):
    plan = templates.contaminated(docs, spark.createDataFrame([(1, "a b c d e f g h i", "")], BENCH))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- 2


def test_shards_follow_the_key_and_slots_have_no_gaps(docs):
    got = hash_tree.assign(docs).collect()
    assert len(got) == docs.count()
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, hash_tree.SHARDS)
    assert all(len(x) == 1 for x in by_id.values())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = collections.Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert texts == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)


def test_shards_take_by_weight_and_move_inside_changed_subtrees(spark):
    keys = spark.range(20_000)
    a, b = hash_tree.layout(8), hash_tree.layout(8)
    heavy = hash_tree.Node("r0", 5.0, (hash_tree.Node("k0", 4.0, a[0].children[0].children), hash_tree.Node("k1", 1.0, (hash_tree.Node("s4", 1.0, shard=4),))))
    got = keys.select(hash_tree.descend(F.col("id"), (heavy,)).alias("x"), hash_tree.descend(F.col("id"), b).alias("y")).toPandas()
    assert abs((got.x == 4).mean() - 0.2) < 0.02 and abs((got.y == 4).mean() - 0.125) < 0.02
    moved = got[(got.x < 4) & (got.y < 4)]
    assert (moved.x == moved.y).all()  # below an unchanged rack nothing moves


def test_a_new_shard_takes_rows_only_into_itself_at_every_count(spark):
    keys = spark.range(0, 6_000, 1, 1)
    for k in (1, 2, 3, 4, 7, 8, 11, 15, 16, 17, 24, 64):
        at = [hash_tree.place(F.col("id"), hash_tree.layout(n), n) for n in (k, k + 1)]
        moved = keys.select(at[0].alias("a"), at[1].alias("b")).groupBy("a", "b").count().toPandas()
        assert (moved[moved.a != moved.b].b == k).all() and moved.b.nunique() == k + 1
        assert abs(moved[moved.b == k]["count"].sum() / 6_000 - 1 / (k + 1)) < 4 * math.sqrt(1 / (k + 1) / 6_000)
    whole = spark.range(1000).select(hash_tree.place(F.col("id"), hash_tree.layout(16), 16).alias("x"), hash_tree.descend(F.col("id"), hash_tree.layout(16)).alias("y")).toPandas()
    assert (whole.x == whole.y).all()  # a full tree is descended level by level


def _placed(key: int | None, shards: int) -> int:
    """One key's shard by draws of all places, one by one."""
    room = hash_tree.layout(shards)

    def u(name):
        h = DRAWS[key, name] >> 12 & (1 << 52) - 1
        return -math.log((h + 0.5) / 2**52)

    def leaves(node, m):
        if node.shard is not None:
            return [(m, node.shard)]
        x = [u(c.name) / c.weight for c in node.children]
        return [y for c, v in zip(node.children, x, strict=True) for y in leaves(c, m + (v - min(x)))]

    return min(y for r in room for y in leaves(r, u(r.name) / r.weight) if y[1] < shards)[1]


DRAWS: dict = {}


def test_places_match_brute_force(spark):
    names = [f"{x}{k}" for x in "rks" for k in range(24)]
    keys = spark.range(40).select(F.when(F.col("id") > 0, F.col("id")).alias("key"))
    for r in keys.select("key", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64("key", F.lit(n)).alias("h")) for n in names])).alias("x")).collect():
        DRAWS[r.key, r.x.n] = r.x.h
    for shards in (1, 3, 4, 7, 8, 11, 16, 17, 23):
        for r in keys.select("key", hash_tree.place(F.col("key"), hash_tree.layout(shards), shards).alias("x")).collect():
            assert r.x == _placed(r.key, shards)


# --- 3


def base(t: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality_counts_match_brute_force(docs):
    got = divergence.judge(docs).collect()
    assert len(got) == docs.count()
    want = collections.defaultdict(set)
    for d in docs.collect():
        want[d.doc_id].add(base(d.text or ""))
    for r in got:
        n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert n in want[r.doc_id]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)


def test_repeated_words_are_exact_where_hashes_collide(spark):
    r = random.Random(11)
    texts = ["a3596430 b c q1 a5372134 b c q2 a3596430 b c"] + [" ".join(r.choice("abcd") for _ in range(r.randint(0, 90))) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").withColumn("w", divergence.words_of(F.col("t")))
    masks = (-1, 3 << 40, 0)  # whole hashes, two bits of them, none
    for x in df.select("k", *[divergence.repeated_words(F.col("w"), m).alias(f"n{i}") for i, m in enumerate(masks)]).collect():
        assert [x.n0, x.n1, x.n2] == [base(texts[x.k])[4]] * 3


def _frame(f: pd.DataFrame) -> list:
    return sorted(str([None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in x]) for x in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))


def test_quality_query_matches_sql(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        files = f"{folder}/documents.parquet" + ("/*.parquet" if folder == str(tmp_path) else "")
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{files}'")
        assert _frame(divergence.op3_divergence(spark, folder).toPandas()) == _frame(con.sql(divergence.OP3_SQL).df())


def test_quality_judges_rows_and_not_ids(spark):
    r = random.Random(5)
    prose = lambda k: " ".join(r.choice(divergence.COMMON["en"]) if r.random() < 0.4 else "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9))) for _ in range(k))
    rows = [(k % 7, prose(120), "en", 1, "x") for k in range(60)] + [(None, prose(120).upper(), "en", 2, "x"), (None, prose(120), "en", 3, "x"), (3, prose(120).upper(), "en", 2, "x"), (None, None, None, 2, None), (2, prose(120).upper(), "xx", 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, _text string")
    kept = divergence.keep_good(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    got = kept.collect()
    assert sum(x.n_words == 1 for x in got) >= 59 and sum(x.n_words == 3 for x in got) == 1 and not any(x.n_words == 2 for x in got)


def test_quality_rejects_odd_distributions_and_keeps_short_ones(spark):
    r = random.Random(3)
    common = "the of and to in a is that for it with as was on are by".split()
    prose = lambda k: " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9))) for _ in range(k))
    rows = [(k, prose(200), "en") for k in range(80)] + [(100, prose(200).upper(), "en"), (101, re.sub(r"(\w+)", r"\1###", prose(200)), "en"), (102, prose(200).upper(), None), (103, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in divergence.judge(df).collect()}
    assert sum(got[k].kept for k in range(80)) >= 79 and not got[100].kept and not got[101].kept and not got[102].kept and got[103].base_failed
    assert {x.doc_id for x in divergence.keep_good(df).collect()} == {k for k in got if got[k].kept}


def test_js_distance(spark):
    r = np.random.default_rng(1)
    for _ in range(5):
        p, q = r.integers(0, 20, 6).tolist(), r.integers(0, 20, 6).tolist()
        got = spark.range(1).select(divergence.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
        a, b = np.array(p) / sum(p), np.array(q) / sum(q)
        term = lambda x, m: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u > 0)
        assert got == pytest.approx(math.sqrt(max(0, (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)), abs=1e-9)


# --- 4


def cut(rows: list[tuple], w: int) -> collections.Counter:
    big = 1 << 63
    rows = [((d if d is not None else big), t, (t or "").encode().split()) for d, t in rows]
    seen = collections.defaultdict(set)
    for d, t, ws in rows:
        for i in range(len(ws) - w + 1):
            seen[tuple(ws[i : i + w])].add((d, t, i))
    out = collections.Counter()
    for d, t, ws in rows:
        gone = set()
        for i in range(len(ws) - w + 1):
            held = seen[tuple(ws[i : i + w])]
            if min(held, key=lambda x: x[0])[0] < d or any(x == d and y == t and j < i for x, y, j in held):
                gone |= set(range(i, i + w))
        out[None if d == big else d, len(ws), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(ws) if i not in gone)).hexdigest()] += 1
    return out


def test_substrings_keep_the_largest_id_apart_from_none(spark):
    top = (1 << 63) - 1
    text = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(top, f"{text} x"), (None, "y"), (3, text), (None, f"z {text}")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.dedup_substrings(rows).collect())
    assert got == sorted([(str(top), 31, 30), ("None", 1, 0), ("3", 30, 0), ("None", 31, 30)])


def test_the_filter_of_ids_loses_none(spark):
    ids = spark.range(-500, 30_000, 7).select(F.col("id").alias("doc_id"))
    for most in (1 << 13, 1 << 28):
        flags, bits = substrings.id_filter(ids.repartition(5), most)
        assert len(flags) * 8 == bits <= most
        every = np.arange(-500, 30_000)
        held = substrings._may_hold(np.frombuffer(flags.tobytes(), np.uint8), bits, every)
        assert held[(every + 500) % 7 == 0].all() and (most < 1 << 20 or held.mean() < 0.2)


@pytest.mark.parametrize("window", [20, 5])
def test_substrings_match_brute_force(docs, window):
    got = substrings.dedup_substrings(docs, window).collect()
    assert len(got) == docs.count()
    assert collections.Counter(map(tuple, got)) == cut([(d.doc_id, d.text) for d in docs.collect()], window)


def test_texts_that_share_an_id_are_cut_apart(spark):
    r = random.Random(31)
    line = [str(k) for k in range(40)]
    rows = []
    for k in range(60):
        words = [r.choice("abcdefgh") for _ in range(r.randint(0, 30))]
        at = r.randint(0, len(words))
        for _ in range(r.choice([0, 1, 1, 2])):
            words[at:at] = line[r.randint(0, 15) : r.randint(20, 40)]
        rows.append((r.choice([None, 1, 2, 3, k]), " ".join(words)))
    rows += [(None, None), rows[5], rows[6], (3, rows[7][1])]
    for window in (20, 5):
        got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window).collect()
        assert collections.Counter(map(tuple, got)) == cut(rows, window)


def test_substring_parts_on_random_words():
    r = random.Random(5)
    for _ in range(30):
        texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(5)] + [None, "  x "]
        w = substrings.Windows(pa.array(texts, pa.string()), 5)
        flat = [(k, x) for k, t in enumerate(texts) for x in (t or "").split()]
        assert w.row.tolist() == [k for k, _ in flat]
        ids: dict = {}
        keys = [tuple(x for _, x in flat[i : i + 5]) for i in range(len(flat) - 4)]
        for k, h in zip(keys, substrings.rolling(w.words, 5, substrings._MULTIPLIERS[2]).tolist(), strict=True):
            assert ids.setdefault(k, h) == h
        assert len(set(ids.values())) == len(ids)


# --- 5


def test_urls_as_of(spark, monkeypatch):
    entries = [("spam", "domain", "bad.com", "add", 100), ("spam", "domain", "bad.com", "remove", 200), ("spam", "domain", "BAD.com", "add", 300), ("spam", "domain", "bad.com", "add", 350), ("spam", "domain", "tie.com", "add", 5), ("spam", "domain", "tie.com", "remove", 5), ("x", "prefix", "ok.com/a/b", "add", 0), ("y", "domain", "com", "add", 1000), (None, "domain", None, "add", 1), ("z", "other", "ok.com", "add", 1)]
    captures = [("http://www.Bad.com/x", 99), ("http://www.Bad.com/x", 100), ("http://bad.com:80/x", 199), ("https://u@bad.com", 200), ("http://bad.com.", 300), ("http://bad.com/", 400), ("http://notbad.com/", 150), ("http://tie.com", 9), ("http://ok.com/a/b/c?x", 1), ("http://ok.com/a/bc", 1), ("http://ok.com/a/b", 2000), (None, 150), ("bad.com", 150), ("http://bad.com/", None), ("http://bad.com/", 400)]
    df = spark.createDataFrame([(k, u, t, "clash", True) for k, (u, t) in enumerate(captures)], "page_id long, url string, fetched_at long, host string, blocked boolean")
    for limit, frequent in ((1000, 10_000), (3, 4), (0, 4), (0, 10_000)):  # broadcast, or by key; frequent keys broadcast, or salted
        monkeypatch.setattr(temporal_urls, "FREQUENT", frequent)
        got = {r.page_id: r for r in temporal_urls.filter_urls(df, spark.createDataFrame(entries, temporal_urls.LIST_COLUMNS), broadcast_rows=limit).collect()}
        assert [k for k in sorted(got) if got[k].blocked] == [1, 2, 4, 5, 8, 10, 14] and len(got) == len(captures)
        assert got[10].n_lists == 2 and got[10].value == "ok.com/a/b" and got[1].valid_from == 100 and got[5].valid_from == 350


# --- 6


def tokens(path=None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or default_path())


def test_encoder_matches_the_tokenizer():
    t = tokens()
    texts = [r[1] for r in corpus(4)] + ["It's 5km; THE   İstanbul  ΣΑΣ’ he's!'s a_b '' <|endoftext|> x", None, "don’t … — “q” ²³ ½ é́", "a\x1cb 12ab34 _'re ''ll", "ı ŉ İ ĳ", "x" * 5000, "日本語 テキスト"]
    ids, n = WordEncoder(default_path()).encode(pa.array(texts, pa.string()))
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def check_packed(rows, texts: dict, sequence: int) -> None:
    t = tokens()
    by_doc = collections.defaultdict(list)
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = [*t.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        copies = len(parts) // -(-len(ids) // sequence)
        for p in parts:
            part = ids[p.start : p.start + p.length]
            assert p.start == p.piece * sequence and p.length == len(part) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(p.length for p in parts) == copies * len(ids)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sequence


def test_packing_places_every_piece(docs):
    texts = {d.doc_id: d.text for d in docs.collect()}
    rows = packing.pack_documents(docs, sequence=512).collect()
    check_packed(rows, texts, 512)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 512) * 1.1 + 2
    small = packing.pack(packing.stored(packing.pieces(docs, sequence=512), "pieces"), 512, chunk=15).collect()  # several chunks and a second round
    check_packed(small, texts, 512)


def test_sum_of_squares_takes_the_smallest_change():
    r = random.Random(2)
    for _ in range(20):
        cap, items = 12, [r.randint(1, 12) for _ in range(40)]
        bins, offsets, gaps = packing.sum_of_squares(np.array(items), cap)
        state: list[int] = []
        for s, b, o in zip(items, bins.tolist(), offsets.tolist(), strict=True):
            count = collections.Counter(g for g in state if g)
            ss = lambda c: sum(v * v for v in c.values())
            costs = {}
            for g in {*(g for g in count if g >= s), None}:
                c = collections.Counter(count)
                if g is not None:
                    c[g] -= 1
                left = (cap if g is None else g) - s
                if left:
                    c[left] += 1
                costs[g] = ss(c)
            g = None if b == len(state) else state[b]
            assert costs[g] == min(costs.values()) and o == cap - (cap if g is None else g)
            if g is None:
                state.append(cap)
            state[b] -= s
        assert state == gaps.tolist()


# --- 7

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def personal(t: str) -> list:
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    good = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if good[k](m.group())]


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    parts = ["a", "b.", "@", "@x.y", ".", "1", "23", "255", "256.1", "1.2.3.4", "+1 ", "(", "-", " ", "4111111111111111", "é", "\n", "000"]
    for _ in range(20_000):
        s = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert pii.base_spans(s) == personal(s), s
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == [] and len(pii.base_spans("x" * 50_000 + "@a.b")) == 1


def found_and_wrong(texts: list) -> tuple:
    """Of marked spans by kind: how many, how many found (those that base spans cover count), and added spans that are none."""
    marked, found, wrong = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, spans), (base_, every) in zip(texts, pii.all_spans([t for t, _ in texts], pii.model()), strict=True):
        for k, b, e in spans:
            marked[k] += 1
            found[k] += (k, b, e) in every or any(b < y and x < e for _, x, y in base_)
        wrong.update(x[0] for x in every if x not in base_ and x not in spans)
    return marked, found, wrong


def test_trees_are_right_on_texts_they_have_not_seen():
    marked, found, wrong = found_and_wrong(pii.labelled(2000, seed=99))
    assert all(found[k] >= 0.9 * marked[k] and wrong[k] <= 0.05 * marked[k] for k in range(4)), (marked, found, wrong)
    trees, _ = pii.model()
    rows, y = pii.examples(pii.labelled(1000, seed=98))
    p = trees.probability(np.array([pii.features(*x) for x in rows], float))
    assert abs(p.mean() - y.mean()) < 0.03


def test_recall_by_kind_on_documents(spark):
    """Marked spans put into documents, whose own words are the context; the documents' own numbers are no false alarms."""
    r = random.Random(17)
    prose = [d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    prose = [t for t in prose if not pii.base_spans(t)]
    marks = [(t[b:e], k) for t, spans in pii.labelled(3000, seed=21) for k, b, e in spans]
    texts, alarms = [], 0
    for t, (_, every) in zip(prose, pii.all_spans(prose, pii.model()), strict=True):
        alarms += len(every)
        words, spans, out = t.split(" "), [], ""
        for w in words:
            out += w + " "
            if r.random() < 0.02:
                mark, kind = r.choice(marks)
                spans.append((kind, len(out), len(out) + len(mark)))
                out += mark + r.choice([" ", ". ", ", "])
        texts.append((out, spans))
    marked, found, _ = found_and_wrong(texts)
    assert sum(marked.values()) > 1000 and all(found[k] >= 0.9 * marked[k] for k in range(4)), (marked, found)
    assert alarms <= 0.02 * len(prose)


def test_every_labelled_positive_is_proposed():
    missed = []
    for t, spans in pii.labelled(3000, seed=5):
        base_ = pii.base_spans(t)
        missed += [(t, s) for s in spans if s not in pii.candidates(t) and not any(b < s[2] and s[1] < e for _, b, e in base_)]
    assert not missed, missed[:5]
    for kind, s in [(0, "JOHN.DOE (AT) EXAMPLE (DOT) COM"), (2, "4111 - 1111 - 1111 - 1111"), (1, "2001:db8::1"), (1, "fe80::1ff:fe23:4567:890a"), (1, "2001:db8::ff00:42:8329")]:
        assert (kind, 5, 5 + len(s)) in pii.candidates(f"here {s} ends")
        assert (kind, 5, 5 + len(s)) in pii.all_spans([f"here {s} ends"], pii.model())[0][1], s


def test_numbers_side_by_side_and_long_logs():
    for t in ("call (415) 555-2485 (212) 555-7788 now", "tel 0711 1234 5678 0711 8765 4321", "phone 415-555-2485 / 212-555-7788 x"):
        assert len([s for s in pii.all_spans([t], pii.model())[0][1] if s[0] == 3]) == 2, t
    took = []
    for n in (2_000, 8_000):
        log = "\n".join(f"2024-01-15 12:34:{k % 60:02d} 10.0.{k % 256}.7 GET /a/{k} 200 (415) 555-{k % 10000:04d} id 0711 1234 {k % 10000:04d}" for k in range(n))
        began = time.perf_counter()
        base_, every = pii.all_spans([log], pii.model())[0]
        took.append(time.perf_counter() - began)
        assert sum(s[0] == 1 for s in base_) == n and sum(s[0] == 3 for s in every) >= n
    assert took[1] < 10 * took[0]
    digits = " ".join(str(k % 1000) for k in range(60_000))  # one chain of groups from end to end
    pii.all_spans([digits], pii.model())


def test_added_spans_and_redaction(spark):
    texts = ["call (415) 555-2485 or mail a.b@c.de", "write to jane (at) mail (dot) com now", "released 2024-01-15, version 10.2.33", None, "", "é 4111 1111 1111 1111 end", "see 1990-2000 pages 1234567"]
    df = spark.createDataFrame([(k if k else None, t, 5) for k, t in enumerate(texts)] + [(1, texts[1], 5)], "doc_id long, text string, n_chars long")
    got = sorted(pii.find_personal(df).collect(), key=lambda r: str(r.doc_id))
    assert len(got) == 8 and [r.spans for r in got if r.doc_id is None] == ["email:28:36,phone:5:19"]
    by = {r.doc_id: r for r in got}
    assert by[1].spans.startswith("email:9:") and by[1].n_email == 0 and by[2].spans == "" and by[6].spans == ""
    assert by[5].spans == "card:2:21" and by[5].base_sha256 == hashlib.sha256(b"card:2:21").hexdigest() and by[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = {r.doc_id: r for r in pii.redact_documents(df).collect()}
    assert red[None].text == "call [PHONE] or mail [EMAIL]" and red[None].n_chars == len(red[None].text) and red[3].text is None and red[2].n_chars == 5


# --- 8


def simple_fingerprint(t: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_match_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == collections.Counter((d.doc_id, simple_fingerprint(d.text)) for d in rows)
    fps = {r.doc_id: r.fp % (1 << 64) for r in got}
    group = {k: k for k in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
                    low = min((group[a], group[b]), key=lambda x: (x is None, x))
                    high = group[b] if low == group[a] else group[a]
                    group = {k: low if v == high else v for k, v in group.items()}
    assert all(r.component_id == group[r.doc_id] for r in got)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({v for v in group.values()}, key=str)


def test_lists_link_what_pairs_would(spark):
    r = random.Random(8)
    base_value = r.getrandbits(64)
    values = {base_value ^ sum(1 << r.randrange(16) for _ in range(r.randint(0, 5))) for _ in range(300)}
    values |= {r.getrandbits(64) for _ in range(50)} | {base_value ^ 1 << 63 ^ 1 << 40}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = {x.node % (1 << 64): x.root % (1 << 64) for x in simhash.components(simhash.links(df)).collect()}
    left, parts = set(values), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x = todo.pop()
            part.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        parts.append(part)
    mine = collections.defaultdict(set)
    for v in values:
        mine[found.get(v, v)].add(v)
    assert {frozenset(p) for p in parts} == {frozenset(p) for p in mine.values()}


def test_the_tally_of_positional_bytes_admits_pairs():
    r = random.Random(14)
    same = lambda a, b: sum((a >> 8 * k) & 255 == (b >> 8 * k) & 255 for k in range(8))
    pairs = []
    for _ in range(3000):
        a = r.getrandbits(64)
        pairs.append((a, a ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))})))
        pairs.append((a, a ^ r.getrandbits(8) << 8 * r.randrange(8) ^ r.getrandbits(8) << 8 * r.randrange(8)))
    x, y = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
    tally = simhash.shared_bytes(x, y).tolist()
    assert tally == [same(a, b) for a, b in pairs]
    bits = [(a ^ b).bit_count() for a, b in pairs]
    assert all(t >= 6 for t, n in zip(tally, bits, strict=True) if n <= 2)  # the guaranteed minimum loses none
    assert simhash._linked(x, y, 2).tolist() == [t >= 6 and n <= 2 for t, n in zip(tally, bits, strict=True)]
    assert any(t >= 6 and n > 2 for t, n in zip(tally, bits, strict=True)) and any(t < 6 for t in tally)
    with pytest.raises(ValueError):
        simhash.links(None, 3)


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 50 if k % 3 else 7, k) for k in range(600)], "key long, v long")
    side = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    for most in (1, 4, 10_000):
        got = common.join_hot(rows, side, "key", "n", most).collect()
        assert sorted((x.key, x.v, x.low) for x in got) == sorted((x.key, x.v, x.low) for x in rows.join(side, "key").collect())


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, n)}


def test_near_copies_match_brute_force(spark):
    import corpus_pipeline

    r = random.Random(12)
    text = lambda k: [r.choice("abcdefghijklmnop") + str(r.randint(0, 99)) for _ in range(k)]
    line, rows = text(30), []
    for k in range(12):
        words = text(r.choice([3, 20, 60, 150]))
        rows.append(words)
        for _ in range(3):
            other = list(words)
            for _ in range(r.randint(0, 6)):
                other[r.randrange(len(other))] = "new" + str(r.randint(0, 9))
            rows.append(other)
    rows += [line + text(9) for _ in range(20)] + [text(2) + line for _ in range(20)] + [[], []]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)] + [(0, "another text with this id"), (None, "nobody knows where this is from"), (None, None)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    group = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in near:
        a, b = group[i], group[j]
        group = [b if g == a else g for g in group]
    want = {min(((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "") for i in range(len(rows)) if group[i] == g)) for g in set(group)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert {(x.doc_id is None, x.doc_id or 0, x.text or "") for x in got} == want and len(got) == len(want)


def test_near_copies_are_proposed_by_the_byte_position_index(spark, monkeypatch):
    from weftline.llm import near_copies

    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.choice([40, 400]))) for _ in range(12)]
    texts += [t.rsplit(" ", k)[0] for t in texts for k in (1, 2, 3)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_copies.stored(near_copies._sets(docs, 5, np.zeros(0, np.int64)).dropDuplicates(["key"]), "sets")
    rows = [(x.key, x.fp) for x in sets.where("n > 0").collect()]
    for x in sets.collect():  # the fingerprint is the majority over the set's hashes
        hashes = near_copies.shingles(next(t for k, t in enumerate(texts) if k == x.doc_id).encode(), 5).view(np.uint64)
        assert x.fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))

    def groups(pairs):
        of = {k: k for k, _ in rows}
        for a, b in pairs:
            a, b = of[a], of[b]
            of = {k: b if v == a else v for k, v in of.items()}
        return {frozenset(k for k in of if of[k] == v) for v in of.values()}

    want = groups((a, b) for a, x in rows for b, y in rows if bin((x ^ y) & (2**64 - 1)).count("1") <= 2)
    assert groups((x.a, x.b) for x in near_copies._proposed(sets).collect()) == want and len(want) < len(rows)
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *a: asked.append(distinct.count()) or links(distinct, *a))
    near_copies.keep_one_similar(docs).collect()
    assert asked == [len({f for _, f in rows})]


def test_large_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    from weftline.llm import near_copies

    r = random.Random(6)
    base, rows = ["w" + str(k) for k in range(150)], []
    for k in range(220):  # some of a similarity over 0.8, most below it
        words = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 4, 5])):
            words[r.randrange(10, len(words))] = f"new{r.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    sets = [set(near_copies.shingles(t.encode()).tolist()) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group = list(range(len(rows)))
    for i, j in near:
        a, b = group[i], group[j]
        group = [b if g == a else g for g in group]
    sizes, stored = collections.Counter(), near_copies.stored

    def counted(df, label):
        out = stored(df, label)
        sizes[label] += out.count() if "pairs" in label else 0
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    got = near_copies.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    of = {x.doc_id: x.root for x in got}
    assert all((of[i] == of[j]) == (group[i] == group[j]) for i in of for j in of) and len(of) == len(rows)
    assert 1 < len(set(group)) < len(rows) and len(near) > 10 * len(rows)
    assert max(sizes.values()) <= 5 * len(rows), sizes


def test_near_copies_leave_no_large_tables_behind(spark):
    import os

    from weftline.llm import near_copies

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, root = spark.conf.get(key), common.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    text = lambda k: " ".join(f"w{k}-{i}" for i in range(30))
    rows = [(k, text(k // 2) + (" more" if k % 2 else "")) for k in range(40)]
    found = near_copies.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {x.rsplit("-", 5)[0] if x.count("-") > 4 else x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert not left & {"sets", "distinct-sets", "sketches", "candidates", "members", "compared", "rows"}, left
    assert sorted(x.doc_id for x in found.collect()) == list(range(0, 40, 2)) and spark.conf.get(key) == old


# --- 9


def test_separators_are_stitched_across_blocks(spark):
    r = random.Random(9)
    for width in (1, 3, 7):
        rows, want = [], []
        for f in range(4):
            ids = [r.choice([0, 0, 1, 2, 3, 9]) if f else 5 for _ in range(r.choice([0, 1, 25, 60]) if f else 40)]
            rows += [(f"f{f}", k, bytearray(np.array(ids[at : at + width], "<u2").tobytes())) for k, at in enumerate(range(0, len(ids), width))]
            start = no = 0
            for k, i in enumerate(ids):
                if i == 0:
                    want.append((f"f{f}", no, start, k - start, True))
                    start, no = k + 1, no + 1
            if start < len(ids):
                want.append((f"f{f}", no, start, len(ids) - start, False))
        rows.append(("f9", 0, None))
        got = separators.count_tokens(spark.createDataFrame(rows, separators.BLOCKS), end_id=0, group=3)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_counts_of_documents(docs):
    t = tokens()
    blocks = separators.stored(separators.write_blocks(docs, block_tokens=100), "blocks")
    got = separators.count_tokens(blocks)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(len(t.encode(d.text or "", add_special_tokens=False).ids) for d in docs.collect())


def test_flat_files_are_split_by_byte_range(spark, tmp_path):
    r = random.Random(19)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for width, pool in ((">u2", [49792, 10, 2570, 0xC2, 0x80C2, 0xC280, 0xEFBB, 7]), ("<u2", [0, 10, 2560, 0x0A0A, 0x00C2, 5]), ("<u4", [50257, 10, 0x0A000000, 0x51C4, 0xC4510000, 1])):
            folder, want, end = tmp_path / width.strip("<>") / width[0].replace("<", "l").replace(">", "b"), collections.Counter(), pool[0]
            folder.mkdir(parents=True)
            for f in range(9):
                ids = [r.choice(pool) for _ in range(r.choice([0, 1, 2, 3, 40, 300]))]
                if f == 5:
                    ids = [0xEFBB, 0xBF0A, *ids] if width == ">u2" else ids
                if f == 6:
                    ids = [7 if width != "<u2" else 5] * 400  # no line feed anywhere
                raw = np.array(ids, width).tobytes() + (b"\x07" if f == 7 else b"")
                (folder / f"{f}.bin").write_bytes(raw)
                start = no = 0
                for k, i in enumerate(ids):
                    if i == end:
                        want[f"{f}.bin", no, start, k - start, True] += 1
                        start, no = k + 1, no + 1
                if start < len(ids):
                    want[f"{f}.bin", no, start, len(ids) - start, False] += 1
            for split, chunk in (("200", 1 << 20), ("1000", 16)) if width == ">u2" else (("300", 64),):
                spark.conf.set("spark.sql.files.maxPartitionBytes", split)
                got = separators.count_files(spark, str(folder), end, width, chunk).collect()
                assert collections.Counter((x.file.split("/")[-1], x.doc_no, x.start, x.n_tokens, x.closed) for x in got) == want, (width, split)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_token_counts_name_their_documents(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    t = tokens()
    got = separators.op9_separators(spark, str(tmp_path)).collect()
    assert collections.Counter((x.doc_id, x.n_tokens) for x in got) == collections.Counter((d.doc_id, len(t.encode(d.text or "", add_special_tokens=False).ids)) for d in docs.collect())
    assert separators.count_documents(spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0), str(tmp_path / "none")).count() == 0


# --- 10


def page(body: str, site: str = "<div class='x'>Subscribe to us now</div>") -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{site}<article>{body}</article><footer>&copy; me</footer></body></html>"


def main_text(h: str) -> str:
    parsed = style_tree.parse(h)
    return style_tree.main_text(parsed, [False] * len(parsed.tags))


def test_main_text_of_broken_markup():
    text = main_text
    assert text(page("<h1>A &amp; B</h1><p><b>one<br>two\n three<p>four &lt;x&gt;<!-- no --></p>")) == "A & B\n\none two three\n\nfour <x>"
    assert text(page("<p>keep</p><div class='comments'><p>reader</p></div><form><p>f</p></form><p>more")) == "keep\n\nmore"
    assert text("<body><div id='sidebar'>s</div><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>") == "a\n\nb\n\nc\n\nd\n\ne\n\nf"
    assert text("") == "" and text("plain &eacute; text") == "plain é text" and text("<article><p>cut <a hre") == "cut"
    assert text("<p>" * 3000 + "x") == "x" and text("<div>" * 500 + "deep" + "</div>" * 500) == "deep"


def test_classes_of_the_whole_page_are_not_noise():
    text = main_text
    for outer in ("body class='no-sidebar'", "body class='single comments-open header-fixed'", "main id='content-form'", "article class='post related'", "div class='has-sidebar'"):
        assert text(f"<{outer}><p>kept</p><div class='sidebar'>gone</div></{outer.split()[0]}>") == "kept", outer
    for whole in ("<body class='page has-sidebar'><article><p>Hello world</p></article></body>", "<div class='content with-sidebar'><p>Hello world</p></div>", "<article class='post comment-open'><p>Hello world</p></article>", "<div class='content-sidebar-wrap'><p>Hello world</p></div>", "<nav><ul><li>menu</li></ul><article><p>Hello world</p></article>", "<form id='aspnetForm'><nav>menu</nav><h1>Hello world</h1></form>", "<div class='formula notice-of-motion'>Hello world</div>"):
        assert text(whole) == "Hello world", whole
    for name in ("comments", "comment-list", "ad", "site-footer", "main-navigation", "relatedPosts", "cookie-notice", "left_sidebar", "share-buttons"):
        assert text(f"<article><p>kept</p><div class='{name}'>gone</div></article>") == "kept", name
    assert text("<article><p>kept</p><article class='comment' id='comment-3'><p>reader</p></article></article>") == "kept"


def test_deep_and_broken_pages_take_linear_time():
    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        for h in ("<div>a" * n + "</section>" * n, "<p><div>" + "<center>b" * n + "</p>" * n, "<section>" * n + "</div>c" * n, "<ul><li>d" * n):
            parsed = style_tree.parse(h)
            assert len(list(style_tree.observe(parsed, "h"))) > 0 and style_tree.main_text(parsed, [False] * len(parsed.tags))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] and took[1] < 30


def test_importances_match_brute_force(spark):
    r = random.Random(4)
    rows = []
    for k in range(60):
        host = f"h{k % 3}.com"
        menu = "".join(f"<li>{r.choice('abc')}</li>" for _ in range(r.randint(1, 2)))
        boxes = "".join(f"<div class='box{r.randint(1, 9)}'>{r.choice('xyz')}</div>" for _ in range(r.randint(0, 2)))
        rows.append((k, f"http://{host}/{k}", f"<html><body><div class='menu2'><ul>{menu}</ul></div><div id='c'>{boxes}<p>{r.randint(0, 40)}</p></div></body></html>"))
    rows.append(rows[7])
    seen: dict = collections.defaultdict(dict)
    for _, url, h in rows:
        root = ElementTree.fromstring(h)
        whole, texts, shown, parent = "\n".join(x for x in root.itertext()), collections.defaultdict(list), collections.defaultdict(set), {}

        def walk(e, path, up, texts=texts, shown=shown, parent=parent):
            style = e.tag + (f".{re.sub('[0-9]+', '#', e.get('class') or e.get('id'))}" if e.attrib else "")
            path = (*path, style)
            parent[path] = up
            if up:
                shown[up].add(style)
            inner = [e.text or "", *[walk(c, path, path) for c in e]]
            texts[path].append(tuple(x for x in inner if x))
            return texts[path][-1]

        walk(root, (), ())
        for path, t in texts.items():
            if any(t):
                seen[url.split("/")[2], path][whole] = (tuple(t), frozenset(shown[path]))
    want = []
    for pages in seen.values():
        spread = []
        for side in (0, 1):
            n = collections.Counter(x[side] for x in pages.values()).values()
            m = sum(n)
            spread.append(-sum(v / m * math.log(v / m) for v in n) / math.log(m))
        want.append((len(pages), round(max(spread), 9)))
    got = style_tree.importances(spark.createDataFrame(rows, "page_id long, url string, html string"), priors=False).collect()
    assert sorted((x.m, round(x.importance, 9)) for x in got) == sorted((m, i if i else 0.0) for m, i in want)


def test_importance_alone_finds_the_article_of_whole_sites(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    with_styles, alone = (style_tree.extract(pages, priors=p) for p in (True, False))
    assert style_tree.noise_nodes(pages, priors=False).count() > 200
    both = with_styles.select("page_id", "text").join(alone.select("page_id", F.col("text").alias("other")), "page_id")
    n, same, untouched = both.select(F.count("*"), F.count_if(F.col("text") == F.col("other")), F.count_if(F.col("other").contains("\u00a9"))).first()
    assert n == 2500 and same >= 0.99 * n and untouched <= 0.01 * n


def test_site_trees_find_repeated_branches(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    rows = [(k, f"http://site.com/{k}", page(f"<p>{word()} {word()}</p><div class='box'>same words here</div><p>{word()}</p>"), "clash") for k in range(30)]
    rows += [(k, "http://copies.com/", page("<p>always the same</p><div class='box'>but an article</div>"), "clash") for k in range(100, 130)]
    rows += [(200, None, page("<p>no host</p>"), ""), (201, "http://site.com/z", None, ""), (None, "http://site.com/n", "", ""), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for limit in (1000, 0):
        got = style_tree.extract(df, broadcast_nodes=limit).collect()  # by broadcast, then by a join
        assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
        by = {x.page_id: x.text for x in got}
        assert all("same words" not in by[k] and len(by[k].split("\n\n")) == 2 for k in range(30))
        assert by[100] == "always the same\n\nbut an article" and by[200] == "no host" and by[201] == by[None] == ""


def test_entropy_leaves_articles_whole(spark):
    rows = [(k, "http://food.com/", page(f"<h2>Method</h2><p>stir {k} times</p>")) for k in range(12)]
    rows += [(k, "http://two.com/", page(f"<div class='c'><p>article {k % 2}</p></div>", f"<div class='x'>advert {k}</div>")) for k in range(20, 40)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"Method\n\nstir {k} times" for k in range(12)}, **{k: f"article {k % 2}" for k in range(20, 40)}}


# --- the pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    common = "the of and to in a is that for it with as was on are by".split()
    prose = lambda k: " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9))) for _ in range(k))
    item = prose(30)
    rows = [(k, prose(120), "en", "s", 1) for k in range(40)]
    rows[5] = (5, rows[4][1], "en", "s", 1)
    rows[6] = (6, f"{rows[6][1]} {item} {prose(20)}", "en", "s", 1)
    rows[7] = (7, f"{rows[7][1]} a.b@c.de {prose(9)}", "en", "s", 1)
    rows += [(50, "short but fine", "en", "s", 1), (51, rows[8][1].upper(), "en", "s", 1), (52, " \n", "en", "s", 1), (53, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = {d: t for d, t, *_ in rows if d not in (5, 6, 51, 52, 53)}
    texts[7] = texts[7].replace("a.b@c.de", "[EMAIL]")
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), texts, packing.SEQUENCE)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_url_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    got, want = temporal_urls.op5_temporal_urls(spark, folder).toPandas(), con.sql(temporal_urls.OP5_SQL).df()
    key = lambda f: sorted(str([None if pd.isna(v) else (int(v) if isinstance(v, float) else v) for v in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
    assert key(got) == key(want)
