import gzip
import hashlib
import math
import pickle
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from linkrank.llm import decontamination, jaccard, media, packing, quality, repeats, sharding, suffix_array, suffix_tree, symbols, toxicity, warc
from linkrank.llm.common import scratch_dir, ship
from linkrank.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("aeioustnrlé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus():
    passage, base = prose(70), prose(120).split()
    docs = [prose(rng.randint(1, 150)) for _ in range(30)]
    docs += [f"{prose(20)} {passage} {prose(15)}" for _ in range(4)] + [passage] * 3
    for _ in range(6):
        near = list(base)
        near[rng.randrange(len(near))] = prose(1)
        docs.append(" ".join(near))
    docs += ["", " \n\t", "one", "one", "Two WORDS", "two words", "ab " * 300, "x" * 5000, "=" * 450, "É" * 300, "été, " * 100, prose(9000)]
    rows = [(i, t) for i, t in enumerate(docs)] + [(100, None), (None, docs[0]), (None, "alone with no id at all"), (5, docs[5]), (5, docs[5]), (3, passage)]
    rng.shuffle(rows)
    return rows


DOCS = corpus()
ITEMS = [(1, prose(25)), (2, DOCS[0][1] or "x"), (10, "one"), (3, ""), (4, None), (None, "two words"), (7, " ".join(prose(80).split()[:12])), (2, "two, words")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables as the queries read them, of several files each, with extra columns whose names clash."""
    ship(spark)

    def make(docs, items, labels, pages):
        d = str(tmp_path_factory.mktemp("tables"))
        write = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
        clash = ", key string, n long, start long, item_id string, media string, sid long, low long, token string"
        tail = ("k", 1, 2, "i", "m", 3, 4, "t")
        write([(i, t, "en", None, None, *tail) for i, t in docs], SCHEMA + clash.replace(", n long", ", n long"), "documents")
        write(items, "item_id long, text string", "benchmark")
        write(labels, "doc_id long, quality int, toxic int", "labels")
        write(pages, "page_id long, url string, html string", "pages")
        return d

    pages = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a\r\n/4", ""), (None, "u", "<p>é</p>"), (5, "u", "a\r\n\r\nWARC/1.1\r\n"), (2, "http://a/2", "<p>é</p>"), (6, "u", "x" * 300_000)]
    full = make(DOCS, ITEMS, [(0, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (0, 1, 1)], pages)
    return {"full": full, "empty": make([], [], [], []), "pages": pages}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tables, name):
    df = QUERIES[name](spark, tables["empty"])
    assert df.collect() == [] and df.columns


def test_decontamination(spark, tables):
    got = rows(QUERIES["op1_decontamination"](spark, tables["full"]))
    assert got == sorted(brute.contamination(DOCS, ITEMS), key=repr)


@pytest.mark.parametrize("most", [0, 10**6])
def test_decontamination_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    """Items of every length, one passage in many items, repeated words, copies, and a window that needs the last word."""
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", most)
    r = random.Random(81)
    passage, few = prose(12, r), VOCABULARY[:4]
    items = [(i, f"{passage} {prose(i % 3, r)}") for i in range(30)] + [(100 + n, " ".join(r.choice(few) for _ in range(n))) for n in (1, 2, 3, 4, 9, 10, 11)]
    items += [(None, prose(14, r)), (7, prose(3, r)), (300, "zz zz zz zz zz zz zz zz zz zz")]
    docs = [(i, " ".join(r.choice(few) for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs += [(100, passage), (101, passage), (102, f"{prose(9, r)} {passage.upper()}"), (103, "zz " * 40), (104, items[-3][1]), (105, "zz " * 9), (None, passage), (106, items[40][1] if len(items) > 40 else "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = rows(decontamination.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")))
    assert got == sorted(brute.contamination(docs, items), key=repr)


def test_decontamination_finds_planted_passages(spark):
    item = prose(40).replace("é", "e")
    docs = [(1, f"Before {item.upper()} after"), (2, " ".join(item.split()[5:15])), (3, " ".join(item.split()[5:14])), (4, prose(40))]
    df = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["contaminated"] for r in df.collect()} == {1: True, 2: True, 3: False, 4: False}
    kept = decontamination.clean_documents(spark.createDataFrame([*docs, (5, None)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} >= {3, 4, 5}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, tables, k, num):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    got = rows(jaccard.similar_documents(docs, k, num, 100), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(DOCS, k, num, 100), key=repr)


def test_jaccard_group_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = prose(150).split()
    docs = []
    for i in range(40):
        near = list(base)
        near[3 * i] = f"changed{i}"
        docs.append((i, " ".join(near)))
    df = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100)
    assert {r["component_id"] for r in df.collect()} == {0}


@pytest.mark.parametrize("kinds", [1, 2])
def test_very_many_near_copies_do_not_meet_in_pairs(spark, monkeypatch, kinds):
    """4000 near copies, of one text or of two that share a third, in blocks of 50: each set moves a bounded number of times."""
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    moved, compared = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda bodies, visits, *a: (moved.append(visits.count()), compared(bodies, visits, *a))[1])
    r = random.Random(91)
    common, bases = prose(50, r).split(), [prose(100, r).split() for _ in range(kinds)]
    docs = []
    for i in range(4000):
        near = [*common, *bases[i % kinds]]
        near[50 + i % 97] = f"changed{i // 97}"
        docs.append((i, " ".join(near)))
    df = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 3, 90, 100)
    assert {(r["doc_id"] % kinds, r["component_id"]) for r in df.collect()} == {(k, k) for k in range(kinds)}
    assert sum(moved) < 3 * len(docs), moved


def test_least_reached_against_plain_search():
    r = random.Random(77)
    for _ in range(100):
        n = r.randint(2, 40)
        pairs = [(r.randrange(n) * 7, r.randrange(n) * 7) for _ in range(r.randint(1, 40))]
        near = {x: {x} for p in pairs for x in p}
        for _ in range(n):
            for a, b in pairs:
                near[a] = near[b] = near[a] | near[b]
        u, v = (np.array(c) for c in zip(*pairs, strict=True))
        nodes, roots = jaccard.least_reached(u, v)
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {x: min(near[x]) for x in near}


def test_one_of_each_group_stays(spark):
    base = prose(200)
    docs = [(4, base + " end", 1), (2, base, 2), (2, base, 3), (9, prose(50), 4), (None, "", 5), (None, None, 6), (7, base, 7)]
    kept = jaccard.one_of_each(spark.createDataFrame(docs, "doc_id long, text string, key int")).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, 2, 9] and {r["key"] for r in kept} >= {4, 5, 6}


def test_one_of_each_where_ids_repeat_or_are_null(spark, tables):
    """Two unlinked texts under one doc_id that is least for both stay both; of near copies without any doc_id one stays."""
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    got = rows(jaccard.one_of_each(docs), "doc_id", "text")
    assert got == sorted(brute.one_of_each(DOCS, 5, 80, 100), key=repr) and len([t for i, t in got if i == 3]) == 2
    r = random.Random(21)
    base, other = prose(200, r), prose(200, r)
    made = [(1, base), (1, other), (2, f"{base} end"), (3, f"{other} end")]
    near = prose(200, r)
    made += [(None, near), (None, f"{near} more"), (None, f"start {near}"), (None, near), (None, prose(60, r))]
    got = rows(jaccard.one_of_each(spark.createDataFrame(made, "doc_id long, text string").repartition(3)))
    assert got == sorted(brute.one_of_each(made, 5, 80, 100), key=repr) and [i for i, _ in got].count(1) == 2 and [i for i, _ in got].count(None) == 2


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_of_a_long_chain(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "TASK_EDGES", most)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (499, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 499}


def test_substrings(spark, tables):
    assert rows(QUERIES["op5_substring_dedup"](spark, tables["full"])) == sorted(brute.words_left(DOCS), key=repr)


def test_suffix_array(spark, tables):
    assert rows(QUERIES["op9_suffix_array_dedup"](spark, tables["full"])) == sorted(brute.bytes_left(DOCS), key=repr)


@pytest.mark.parametrize("crowd", [1, 6])
def test_crowded_anchors_are_dealt_out(spark, tables, monkeypatch, crowd):
    """Passages among many surroundings, cut at many places, and periodic texts: the finer groups give what one would."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    r = random.Random(5)
    words = prose(160, r).split()
    docs = [(i, f"{prose(r.randint(0, 30), r)} {' '.join(words[r.randint(0, 60) : 160 - r.randint(0, 60)])}{r.choice(' \n')}{prose(r.randint(0, 30), r)}") for i in range(60)]
    docs += [(100 + i, prose(i, r) + " " + "ab  cd " * (40 + i)) for i in range(8)] + DOCS[::2]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    d.write.parquet(f"{(path := scratch_dir(spark))}/documents.parquet")
    assert rows(QUERIES["op9_suffix_array_dedup"](spark, path)) == sorted(brute.bytes_left(docs), key=repr)
    assert rows(QUERIES["op5_substring_dedup"](spark, path)) == sorted(brute.words_left(docs), key=repr)


def test_neighbour_prefix_tells_padding_from_nul_bytes():
    """A short row that padding would make equal to longer ones does not come between two that agree further."""
    r = random.Random(31)
    for _ in range(200):
        texts = [bytes(r.choice(b"\0\0\0a") for _ in range(r.randint(1, 9))) for _ in range(r.randint(2, 7))]
        group = np.array([r.randrange(2) for _ in texts])
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        shared = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        for step, at, read in ((1, first, texts), (-1, first + sizes - 1, [t[::-1] for t in texts])):
            got = suffix_array._neighbour_prefix(group, data, at, step, sizes).tolist()
            assert got == [max((shared(x, y) for j, y in enumerate(read) if j != i and group[j] == group[i]), default=0) for i, x in enumerate(read)]


@pytest.mark.parametrize("crowd", [1, 1024])
def test_suffix_array_with_runs_of_nul(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    r = random.Random(32)
    core = prose(30, r)[:105]
    docs = []
    for i in range(60):
        left, right = (prose(40, random.Random(40 + i % 2))[:60] + "\0" * r.randint(0, 120), "\0" * r.randint(0, 120) + prose(40, random.Random(50 + i % 3))[:60])
        docs.append((i, left + core + right))
    docs += [(100 + i, core + "\0" * (95 + i)) for i in range(4)] + [(200 + i, "\0" * (40 + i) + core + "\0" * 80) for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{(path := scratch_dir(spark))}/documents.parquet")
    assert rows(QUERIES["op9_suffix_array_dedup"](spark, path)) == sorted(brute.bytes_left(docs), key=repr)


def test_text_without_repeats_keeps_whole_characters(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    left = suffix_array.without_repeats(docs).collect()
    assert len(left) == len(DOCS) and left[0].asDict().keys() == set(docs.columns)
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=repr) == sorted(brute.texts_left(DOCS), key=repr)
    assert any(r["text"] and r["text"] != dict(DOCS).get(r["doc_id"]) for r in left)


def test_collection_arrays_against_sorting():
    r = random.Random(1)
    for _ in range(60):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 8))]
        owner, size, common = suffix_array.collection_arrays(texts, 5)
        tail = lambda i, n: texts[i][len(texts[i]) - n :]  # noqa: E731, B023
        want = sorted(((i, n) for i, t in enumerate(texts) for n in range(len(t) + 1)), key=lambda x: [*((v + 1, 0) for v in tail(*x)), (0, x[0])])
        assert list(zip(owner.tolist(), size.tolist(), strict=True)) == want
        for (a, b), c in zip(zip(want, want[1:], strict=False), common[1:].tolist(), strict=True):
            x, y = tail(*a), tail(*b)
            assert c == min(5, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))


def test_external_columns_give_the_same(monkeypatch, tmp_path):
    texts = [prose(30).encode() for _ in range(5)]
    inside = suffix_array.collection_arrays(texts)
    monkeypatch.setattr(suffix_array, "IN_MEMORY", 0)
    made = []
    monkeypatch.setattr(suffix_array.np, "memmap", lambda *a, f=np.memmap, **b: made.append(1) or f(*a, **b))
    assert all((a == b).all() for a, b in zip(inside, suffix_array.collection_arrays(texts, folder=str(tmp_path / "columns")), strict=True))
    assert made and not list((tmp_path / "columns").iterdir())


def test_texts_longer_than_a_block(spark):
    """Several megabytes in one text: windows that end of blocks would cut, repeats far apart, and the long powers."""
    r = random.Random(51)
    passage = prose(400, r)
    long = [prose(330_000, r), passage, prose(300_000, r), passage[:900], " ", passage[900:], prose(50_000, r)]
    edge = symbols.BLOCK - 100
    text = " ".join(long)
    data = text.encode()
    cut = data[edge : edge + 700].decode("utf-8", "ignore")
    docs = [(1, text), (2, f"{prose(30, r)} {cut} {prose(30, r)}"), (3, passage), (4, " ".join(text.split()[symbols.BLOCK - 120 : symbols.BLOCK + 60]))]
    assert len(data) > 4 * symbols.BLOCK and len(text.split()) > symbols.BLOCK + 100
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{(path := scratch_dir(spark))}/documents.parquet")
    assert rows(QUERIES["op9_suffix_array_dedup"](spark, path)) == sorted(brute.bytes_left(docs), key=repr)
    assert rows(QUERIES["op5_substring_dedup"](spark, path)) == sorted(brute.words_left(docs), key=repr)


def test_prefix_groups_split_and_cover():
    text = np.array([random.Random(3).randrange(3) for _ in range(600)] + [0] * 400)
    starts = np.arange(950)
    groups = list(suffix_tree.prefix_groups(text, starts, 50, 20))
    assert sorted(np.concatenate([g for _, g in groups]).tolist()) == starts.tolist()
    assert all(len(g) <= 20 or length == 50 for length, g in groups)
    assert all((text[g[:, None] + np.arange(length)] == text[g[0] + np.arange(length)]).all() for length, g in groups)


def test_subtrees_give_the_maximal_repeats():
    """Against all substrings: the leaves in order, their branching depths, and the repeats that can be extended neither way."""
    r = random.Random(4)
    for _ in range(150):
        texts = [[r.randrange(3) for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 5))]
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes) - sizes
        flat = np.array([x for t in texts for x in t])
        of = np.repeat(np.arange(len(texts)), sizes)
        before = np.append(-1, flat[:-1])
        before[first] = -1
        low = np.array([r.randrange(9) for _ in texts])[of]
        tail = lambda p: tuple(texts[of[p]][p - first[of[p]] :])  # noqa: E731, B023
        got = {}
        for length, group in suffix_tree.prefix_groups(flat, np.flatnonzero((first + sizes)[of] - np.arange(len(of)) >= 2), 2, 3):
            if not len(group):
                continue
            leaves, depths = suffix_tree.subtree(flat, group, (first + sizes)[of[group]], length)
            assert [tail(p) for p in leaves] == sorted(tail(p) for p in group)
            for depth, places, lows in suffix_tree.maximal_repeats(leaves, depths, before[leaves], low[leaves], 2):
                for p, x in zip(places.tolist(), lows.tolist(), strict=True):
                    got.setdefault(tail(p)[:depth], {})[p] = x
        want = {}
        for p in range(len(flat)):
            for n in range(2, len(tail(p)) + 1):
                want.setdefault(tail(p)[:n], set()).add(p)
        want = {
            x: {p: min(low[list(v)]) for p in v} for x, v in want.items()
            if len(v) > 1 and len({tail(p)[len(x)] if len(tail(p)) > len(x) else (p,) for p in v}) > 1 and (len({before[p] for p in v}) > 1 or -1 in {before[p] for p in v})
        }
        assert got == want


def thue_morse(n):
    """Two words of 2**n letters that every polynomial hash modulo 2**64 takes for one."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(10)
    first, second = ("".join(x) for x in (a, b))
    ids = [symbols.words(f"{w} x".encode(), symbols.SPACED_FOLDED)[2].tolist() for w in (first, second, first[:64], second[:64])]
    assert len({tuple(x) for x in ids}) == 4 and len({x[1] for x in ids}) == 1
    around = prose(60, random.Random(9)).split()
    docs = [(i, " ".join([*around[:30], w, *around[30:]])) for i, w in enumerate((first, second))] + [(2, " ".join([first, second] * 30)), (3, " ".join([second, first] * 30))]
    docs += [(4, " ".join([first] * 60)), (5, " ".join([second] * 60))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{(path := scratch_dir(spark))}/documents.parquet")
    assert rows(QUERIES["op5_substring_dedup"](spark, path)) == sorted(brute.words_left(docs), key=repr)
    got = rows(QUERIES["op3_ngram_jaccard"](spark, path), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(docs, 3, 90, 100), key=repr)


def test_media(spark, tables):
    got = {}
    for r in QUERIES["op6_media_chunks"](spark, tables["full"]).collect():
        got.setdefault(r["payload_sha256"], set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in got.values())
    for _, t in DOCS:
        data = (t or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        stored = media.to_media(padded)
        assert media.from_media(stored) == padded and b"".join(media.chunks(stored)) == stored
        (n, size, _, tail, whole, digest, _), = got[hashlib.sha256(padded).hexdigest()]
        assert (n <= len(padded), size, tail, whole, digest) == (True, len(padded), zlib.crc32(padded[-32:]), len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("hot", [1, 1000])
def test_shared_chunks_are_stored_once(spark, monkeypatch, hot):
    monkeypatch.setattr(media, "HOT", hot)
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh ") for _ in range(40_000))
    docs = spark.createDataFrame([(i, prose(i + 1) + long) for i in range(6)], "doc_id long, text string")
    kept = media.store(docs, media.catalog(docs)).collect()
    names = [n for x in kept for n, c in zip(x["digests"], x["chunks"], strict=True) if c is not None]
    assert len(names) == len(set(names)) and any(not x["whole"] for x in kept)
    got = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    for i, t in docs.collect():
        data = media.payload(t)
        assert (got[i]["payload_sha256"], got[i]["feature"]) == (hashlib.sha256(data).hexdigest(), media.features(data))


def test_features_are_those_of_plain_sums():
    for text in ("", "a", "é" * 700, prose(400)):
        data = media.payload(text)
        mean = sum(data) / len(data)
        share = [data.count(b) / len(data) for b in set(data)]
        quarter = len(data) // 4
        want = f"24x{len(data) // 24} mean={mean:.3f} std={(sum((b - mean) ** 2 for b in data) / len(data)) ** 0.5:.3f} entropy={-sum(p * math.log2(p) for p in share):.3f} "
        want += "quarters=" + ",".join(f"{sum(data[i * quarter : (i + 1) * quarter]) / quarter:.3f}" for i in range(4))
        assert media.features(data).replace("-0.000", "0.000") == want.replace("-0.000", "0.000")


def test_sharding(spark, tables):
    got = QUERIES["op7_feistel_sharding"](spark, tables["full"]).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(DOCS) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS}


def test_sharding_with_clashing_columns(spark):
    """Columns with the names of the added ones are replaced, whatever their case; the order may go by them; nulls and repeated rows have places."""
    made = [(i % 5 or None, i % 7, "x", i) for i in range(40)] * 2
    df = spark.createDataFrame(made, "slot long, place int, Shard string, part long").repartition(3)
    got = sharding.feistel_shards(df, ["slot", "part"], 3).collect()
    assert len(got) == 80 and sorted(got[0].asDict()) == sorted(["place", "part", *sharding.ADDED])
    assert sorted(r["row_no"] for r in got) == list(range(80)) and all(r["shard"] + 3 * r["slot"] == r["shuffled"] == sharding.permute(r["row_no"], 80, 20_240_501) for r in got)
    assert [r["part"] for r in sorted(got, key=lambda r: r["row_no"])] == [p for _, p in sorted(((s or 0), p) for s, _, _, p in made)]


@pytest.mark.parametrize("which", ["full", "empty"])
def test_queries_equal_their_sql(spark, tables, which):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{tables[which]}/{t}.parquet/*.parquet'")
    for name, sql in SQL.items():
        df, want = QUERIES[name](spark, tables[which]), con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        got = rows(df, *want.columns)
        if name == "op7_feistel_sharding":  # rows that agree in the whole order may change places
            where = [want.columns.index(c) for c in ("shard", "slot")]
            assert sorted(tuple(r[i] for i in where) for r in got) == sorted(tuple(r[i] for i in where) for r in want.fetchall())
            got, want = ([tuple(x for i, x in enumerate(r) if i not in where) for r in v] for v in (got, want.fetchall()))
            assert sorted(got, key=repr) == sorted(want, key=repr)
        else:
            assert got == sorted(map(tuple, want.fetchall()), key=repr), name


def test_permutation_is_computable_both_ways(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        to = [sharding.permute(i, n, 5) for i in range(n)]
        assert sorted(to) == list(range(n)) and [sharding.unpermute(x, n, 5) for x in to] == list(range(n))
    placed = sharding.feistel_shards(spark.range(97), ["id"], seed=5).collect()
    assert all(r["shuffled"] == sharding.permute(r["row_no"], 97, 5) and r["row_no"] == r["id"] for r in placed)


def test_packing(spark, tables):
    got = QUERIES["op4_best_fit_packing"](spark, tables["full"]).collect()
    encode = packing.encoder(packing.tokenizer_path())
    want = []
    for i, t in DOCS:
        ids = np.append(encode(t or ""), 0).astype("<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in bins.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_ids_are_those_of_the_json_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t, encode = tokenizers.Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path())
    for text in [x or "" for _, x in DOCS] + ["a<|endoftext|>b", "  \n\n x　y 'é' 12345 \U0001f600", "\x00\x7f"]:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_fills_bins():
    r = np.random.default_rng(4)
    sizes = r.integers(1, 2048, 4000)
    bins, fill = packing.sum_of_squares(sizes, 2048)
    assert fill.max() <= 2048 and (np.bincount(bins, sizes) == fill).all() and len(fill) <= 1.02 * sizes.sum() / 2048


def test_pieces_are_refitted_to_save_bins():
    r = np.random.default_rng(5)
    for n, least in ((1, 1), (2, 1), (700, 1), (700, 300), (4000, 20)):
        sizes = np.minimum(r.geometric(0.004, n) + least - 1, 2048)
        first, filled = packing.sum_of_squares(sizes, 2048)
        bins, fill = packing.refitted(sizes, first, filled, 2048)
        assert len(fill) <= len(filled) and fill.max() <= 2048 and fill.min() > 0 and (np.bincount(bins, sizes) == fill).all()
        if least == 1:
            assert len(fill) <= -(-sizes.sum() // 2048) + (n > 2) and len(fill) >= -(-sizes.sum() // 2048)
        at = packing.offsets(sizes, bins)
        for b in np.unique(bins):
            here = np.flatnonzero(bins == b)
            assert np.array_equal(at[here], np.cumsum(sizes[here]) - sizes[here])


def test_warc(spark, tables):
    got = rows(QUERIES["op10_warc_transactions"](spark, tables["full"]), "page_id", "payload_bytes", "record_type", "refers_to")
    same = len("<p>é</p>".encode())
    assert got == sorted([(1, same, "revisit", 2), (2, same, "response", None), (2, same, "response", None), (None, same, "revisit", 2), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 15, "response", None), (6, 300_000, "response", None)], key=repr)


def test_captures_are_nested_and_checked(spark, tables):
    path = scratch_dir(spark)
    warc.write_pages(spark.createDataFrame(tables["pages"], "page_id long, url string, html string"), path, min_revisit_bytes=5)
    c = {r["metadata"]["page_id"]: r for r in warc.captures(warc.read_records(spark, path)).collect()}
    assert c[5]["response"]["payload"] == b"a\r\n\r\nWARC/1.1\r\n" and c[5]["request"]["target_uri"] == "u" and c[1]["response"]["payload"] is None
    assert c[3]["response"]["record_type"] == c[4]["response"]["record_type"] == "response"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_archive(b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 9\r\n\r\nabc"))


@pytest.mark.parametrize(("size", "most"), [(1, 0), (1 << 26, 10**6)])
def test_archives_read_in_pieces(spark, tmp_path, monkeypatch, size, most):
    """Payloads with record separators in them, a very long one, many files or one; copies joined by broadcast or by salted shuffle."""
    monkeypatch.setattr(warc, "IN_BROADCAST", most)
    texts = ["", "a", warc.NEXT, f"x{warc.NEXT}WARC-Type: response\r\nContent-Length: 0\r\n\r\n", "\r\n" * 9, "\r\n\r\nWARC/1.1\r", "é" * 2_000_000, "\x00\x01"]
    pages = [(i, f"http://h/{i}", texts[i % len(texts)]) for i in range(60)]
    warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"), file_bytes=size)
    files = list((tmp_path / "w").glob("*.gz"))
    assert (len(files) >= 60) == (size == 1)
    c = warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()
    got = {r["metadata"]["page_id"]: (r["response"]["record_type"], r["metadata"]["refers_to"], r["response"]["payload"]) for r in c}
    last = {t: i for i, _, t in pages}
    assert got == {i: ("response", None, t.encode()) if last[t] == i else ("revisit", last[t], None) for i, _, t in pages}
    assert len([x for f in files for x in warc.parse_archive(f.read_bytes())]) == 180
    big = max(files, key=lambda f: f.stat().st_size)
    rest = gzip.decompress(big.read_bytes())
    members = gzip.compress(rest[:1000]) + gzip.compress(rest[1000:])
    assert list(warc.parse_archive(members)) == list(warc.parse_archive(big.read_bytes()))
    big.write_bytes(gzip.compress(rest[:-9]))
    (big.parent / f".{big.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="cut short"):
        warc.read_records(spark, str(tmp_path / "w")).collect()


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(11)
    docs, labels = [], []
    for i in range(900):
        text, bad = prose(r.randint(3, 120), r).split(), r.random() < 0.25
        if bad:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["vilest", "scoundrel", "blackguard"]))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(bad)))
    docs += [(5000, None), (5001, ""), (None, "vilest scoundrel")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    truth = {i: any(w in t for w in ("vilest", "scoundrel", "blackguard")) for i, t in docs[:900]}
    held = [i for i in truth if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[None]["held_out"]


def test_toxicity_learns_from_every_labelled_document_and_long_ones(spark, monkeypatch):
    """More documents of a label than 4,000, and one longer than 64 KB: all but the held-out and the calibration fold are counted."""
    ids = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, f"word{i} and one more") for i in ids] + [(9001, "scoundrel and long " * 5000), (9002, "vilest and short"), (9003, "vilest and short")]
    lab = [(i, 0) for i in ids] + [(9001, 1), (9002, 1), (9003, 1)]
    met = []
    monkeypatch.setattr(toxicity, "_counted", lambda sample, f=toxicity._counted: met.append(sample) or f(sample))
    toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    want = {t for i, t in docs if fold(i) not in (toxicity.HELD_OUT, toxicity.CALIBRATION)}
    assert len(want) > 4000 and max(map(len, want)) > 65_536
    assert {r["text"] for r in met[0].collect()} == want


def plain_kneser_ney(texts):
    """p(class, v, w) over the words of the texts and None, from sets and sums."""
    words_of = [(x, re.findall("[a-zé0-9]+", t.lower())) for t, x in texts]
    triples = {(c, u, v, w) for c, t in words_of for u, v, w in zip(["", *t], t, t[1:], strict=False)}
    n = {}
    for c, _, v, w in triples:
        n[c, v, w] = n.get((c, v, w), 0) + 1
    vocabulary = {x for _, v, w in n for x in (v, w)}

    def discount(counts):
        once, twice = (sum(x == k for x in counts) for k in (1, 2))
        return max(0.1, once / (once + 2 * twice)) if twice else 0.75

    def level(counts, below):
        """counts of words, and p of the level below -> p"""
        d, total = discount(counts.values()), sum(counts.values())
        spare = 1 - sum(max(x - d, 0) for x in counts.values()) / total
        return lambda w: max(counts.get(w, 0) - d, 0) / total + spare * below(w)

    types = [{}, {}]
    for c, _, w in n:
        types[c][w] = types[c].get(w, 0) + 1
    shared = level({w: sum(w in t for t in types) for w in {*types[0], *types[1]}}, lambda w: 1 / (len(vocabulary) + 1))
    base = [level(t, shared) for t in types]
    both = {}
    for c, v, w in n:
        both.setdefault((v, w), set()).add(c)
    dp, dc = discount([len(x) for x in both.values()]), [discount([x for (k, *_), x in n.items() if k == c]) for c in (0, 1)]

    def after(counts, d, below, v):
        total = sum(x for (a, _), x in counts.items() if a == v)
        if not total:
            return below
        spare = 1 - sum(max(x - d, 0) for (a, _), x in counts.items() if a == v) / total
        return lambda w: max(counts.get((v, w), 0) - d, 0) / total + spare * below(w)

    pooled = {k: len(x) for k, x in both.items()}
    return vocabulary, lambda c, v: after({(a, b): x for (k, a, b), x in n.items() if k == c}, dc[c], after(pooled, dp, base[c], v), v)


@pytest.mark.parametrize(("words", "texts"), [(12, 25), (3, 60)])
def test_kneser_ney_models_sum_to_one_and_equal_plain_sums(spark, words, texts):
    """Many rare pairs, and few words of which none is rare: what was never seen has a probability above 0 all the same."""
    r = random.Random(71)
    made = [(" ".join(r.choice(VOCABULARY[: words + 2 * x]) for _ in range(r.randint(1, 30))), x) for _ in range(texts) for x in (0, 1)]
    made += [("alone", 0), ("", 1), (None, 0)]
    model = toxicity.kneser_ney(toxicity._counted(spark.createDataFrame(made, "text string, toxic int").repartition(3)), cutoff=0)
    vocabulary, plain = plain_kneser_ney([(t or "", x) for t, x in made])
    assert {int(x) for x in model.word} == {int(toxicity.tokens(w)[0]) for w in vocabulary}
    pruned = toxicity.kneser_ney(toxicity._counted(spark.createDataFrame(made, "text string, toxic int")), cutoff=2)
    assert 0 < len(pruned.pair) <= len(model.pair) and np.isfinite(model.differences(toxicity.tokens(f"new {made[0][0]} words here {made[1][0]}"))).all()
    for v in [*sorted(vocabulary), "neverseen"]:
        want = [plain(c, v) for c in (0, 1)]
        got = {w: model.probabilities(toxicity.tokens(f"{v} {w}"))[:, 1] for w in [*vocabulary, "unheardof"]}
        for c in (0, 1):
            assert sum(p[c] for p in got.values()) == pytest.approx(1, abs=1e-5)
            assert all(p[c] == pytest.approx(want[c](w), rel=1e-4) for w, p in got.items())
        less = np.sum([pruned.probabilities(toxicity.tokens(f"{v} {w}"))[:, 1] for w in got], axis=0)
        assert less == pytest.approx([1, 1], abs=1e-5)
    single = np.sum([model.probabilities(toxicity.tokens(w))[:, 0] for w in [*vocabulary, "unheardof"]], axis=0)
    assert single == pytest.approx([1, 1], abs=1e-5)


def test_toxicity_model_stays_in_files(spark, monkeypatch):
    """Thousands of words and pairs: what is sent to tasks doesn't grow with them, and finds what the arrays have, where there are no files too."""
    made = [(" ".join(f"w{(7 * i + k * k) % 15_000}" for k in range(40)), i % 2) for i in range(2000)]
    counts = toxicity._counted(spark.createDataFrame(made, "text string, toxic int").repartition(3))
    model = toxicity.kneser_ney(counts, cutoff=0)
    sent = pickle.dumps(model)
    assert len(model.word) > 5_000 and len(model.pair) > 10_000 and len(sent) < 10_000
    assert all((np.diff(keys.astype(object)) > 0).all() for keys in (model.word, model.pair))
    monkeypatch.setattr(toxicity, "scratch_dir", lambda spark: "store://host/folder")
    held = toxicity.kneser_ney(counts, cutoff=0)
    assert held.words.path is None and model.words.path
    for text, _ in [*made[:20], ("w1 new w2", 0)]:
        p = model.probabilities(toxicity.tokens(text))
        assert (p == pickle.loads(sent).probabilities(toxicity.tokens(text))).all() and (p == held.probabilities(toxicity.tokens(text))).all()


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_toxicity_model_stays_in_files_of_a_folder_without_a_scheme(spark, tmp_path, scheme):
    """A plain path in spark.checkpoint.dir is as good as one that names its file system: the rows never pass through the driver."""
    session = spark.newSession()
    session.conf.set("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")
    session.conf.set("spark.checkpoint.dir", f"{scheme}{tmp_path}")
    made = toxicity.table(session.range(1000).selectExpr("id key", "id * 2 x"), "<i4")
    assert made.held is None and made.path.startswith(f"{tmp_path}/linkrank-")
    found, there = made.find(np.array([3, 999, 5000], np.uint64))
    assert there.tolist() == [True, True, False] and found[0, :2].tolist() == [6, 1998]


def test_toxicity_counts_each_context_once(spark, monkeypatch):
    """Triples that meet from several pieces, and words with and without a short code."""
    monkeypatch.setattr(toxicity, "TRIPLES", 60)
    monkeypatch.setattr(toxicity, "LEADING", 12)
    made = [(prose(rng.randint(1, 20)), i % 2) for i in range(300)] + [("one two three", x) for x in (0, 1, 1)] + [("", 0), (None, 1), ("alone", 1)]
    sample = spark.createDataFrame(made, "text string, toxic int").repartition(5)
    met = {}
    for text, toxic in made:
        t = [0, *toxicity.tokens(text).view(np.int64).tolist()]
        for u, v, w in zip(t, t[1:], t[2:], strict=False):
            met.setdefault((v, w), (set(), set()))[toxic].add(u)
    stand = {x for k in met for x in k}
    assert 0 < len(stand & set(toxicity._codes(sample).common.view(np.int64).tolist())) < len(stand)
    assert sorted(map(tuple, toxicity._counted(sample).collect())) == sorted((*k, len(a), len(b)) for k, (a, b) in met.items())


@pytest.mark.parametrize("labels", [[(i, 1) for i in range(40)], [(i, 0) for i in range(40)], [(i, i % 2) for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 0]])
def test_toxicity_with_labels_of_one_kind_or_held_out_alone(spark, tables, labels):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, lab)).collect()
    share = float(labels[0][1]) if len({x for _, x in labels}) == 1 else 0.0
    assert len(got) == len(DOCS) and {x["score"] for x in got} == {share}


def test_toxicity_without_labels(spark, tables):
    got = QUERIES["op2_toxicity"](spark, tables["full"]).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)


def plain_rates(rows):
    """Posterior rates of (site, path, y) rows, each without itself, from plain sums."""
    members, total = {}, [y for _, _, y in rows if y is not None]
    for s, p, y in rows:
        if s is not None and y is not None:
            members.setdefault(s, {}).setdefault(p, []).append(y)
    sites = {s: [y for v in d.values() for y in v] for s, d in members.items()}
    mean = lambda v: sum(v) / len(v)
    inside = [v for d in members.values() for v in d.values()]

    def strength(groups, parents):
        """groups: (values, values of the parent)."""
        k, n = len(groups), sum(len(v) for v, _ in groups)
        if n <= k or k <= parents:
            return quality.MOST
        within = sum((y - mean(v)) ** 2 for v, _ in groups for y in v) / (n - k)
        between = sum(len(v) * (mean(v) - mean(u)) ** 2 for v, u in groups)
        outer = (between - (k - parents) * within) / (n - sum(len(v) ** 2 / len(u) for v, u in groups))
        return min(max(within / outer, quality.LEAST), quality.MOST) if outer > 0 else quality.MOST

    everyone = [y for v in sites.values() for y in v]
    over = strength([(v, everyone) for v in sites.values()], 1)
    under = strength([(v, sites[s]) for s, d in members.items() for v in d.values()], len(sites))
    assert sum(map(len, inside)) == len(everyone)
    out = []
    for s, p, y in rows:
        own, n = (y or 0, 1) if y is not None else (0, 0)
        g = (sum(total) - own + 0.5) / (len(total) - n + 1)
        v, w = sites.get(s, []), members.get(s, {}).get(p, [])
        own, n = (own, n) if s is not None else (0, 0)
        site = (sum(v) - own + over * g) / (len(v) - n + over)
        out.append((site, (sum(w) - own + under * site) / (len(w) - n + under)))
    return out


@pytest.mark.parametrize("most", [0, 1000])
def test_quality_posteriors(spark, monkeypatch, most):
    """Broadcast or by shuffle: rates of sites and paths as plain sums give them, without the row itself."""
    monkeypatch.setattr(quality, "IN_BROADCAST", most)
    r = random.Random(8)
    data = []
    for i in range(400):
        s = None if i % 40 == 0 else f"s{min(r.randrange(12), 6)}"
        p = None if s is None else f"p{r.randrange(3)}"
        good = 0.2 + 0.1 * int(s[1:]) + 0.1 * int(p[1:]) if s else 0.5
        data.append((i, s, p, None if i % 17 == 0 else float(r.random() < good) if i % 3 else r.random()))
    got = {x["doc_id"]: x for x in quality.posteriors(spark.createDataFrame(data, "doc_id long, site string, path string, y double").repartition(3)).collect()}
    assert len(got) == len(data)
    for (i, *_), (site, path) in zip(data, plain_rates([x[1:] for x in data]), strict=True):
        assert got[i]["site_rate"] == pytest.approx(site) and got[i]["path_rate"] == pytest.approx(path)
    assert max(x["path_rate"] for x in got.values()) - min(x["path_rate"] for x in got.values()) > 0.2


def test_quality_on_held_out_rows(spark):
    r = random.Random(12)
    docs, labels, truth = [], [], {}
    for i in range(1500):
        site = r.randrange(6)
        good = r.random() < (0.3 if site == 0 else 0.9)
        text = prose(r.randint(20, 120), r)
        if not good:
            text = r.choice([text.upper(), text.replace(" ", " | "), " ".join(w for w in text.split()[:6] for _ in range(15))])
        docs.append((i, text, f"https://Site{site}.example/{'ab'[i % 2]}/x{i}", "en"))
        truth[i] = int(good)
        if i % 3:
            labels.append((i, int(good)))
    docs += [(5000, None, "site0.example", "en"), (5001, " ", "site3.example", "en"), (None, prose(50, r), None, None), (0, *docs[0][1:])]
    schema = "doc_id long, text string, source string, lang string"
    d, lab = spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame([*labels, (None, 0), (7, None)], "doc_id long, quality int")
    rows_out = quality.quality(d, lab).collect()
    got = {x["doc_id"]: x for x in rows_out}
    assert len(rows_out) == len(docs) and got[None]["held_out"] and got[None]["predicted"] == 1
    held = [i for i in truth if got[i]["held_out"]]
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    low, high = ([x["site_rate"] for x in rows_out if x["doc_id"] is not None and x["doc_id"] < 1500 and (docs[x["doc_id"]][2].startswith("https://Site0.")) == bad] for bad in (True, False))
    assert max(low) < 0.5 < 0.8 < min(high) and got[5000]["score"] < got[5001]["score"]


def test_quality_learns_from_every_label_but_held_out_ones(spark, tables):
    """A label in the held-out fold changes nothing; the site and first directory of a URL, or else the name and the language, are its groups."""
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    held = next(i for i, _ in DOCS if i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    scores = [rows(quality.quality(docs, spark.createDataFrame([*((i, i % 2) for i in range(50) if i != held), *extra], "doc_id long, quality int")), "doc_id", "score") for extra in ([], [(held, 0)], [(held, 1)])]
    assert [x[0] for x in scores[0]] == [x[0] for x in scores[1]] and len(scores[0]) == len(DOCS)
    assert all(a[1] == pytest.approx(b[1]) == pytest.approx(c[1]) for a, b, c in zip(*scores, strict=True))
    named = spark.createDataFrame([("HTTP://A.b:80/de/x/1?q=/", "en"), ("A.b/de", "en"), ("src1", None), (" ", "en"), (None, "en"), ("a.b?x=/y/", "fr")], "source string, lang string")
    site, path = quality.site_and_path(named["source"], named["lang"])
    assert [tuple(r) for r in named.select(site, path).collect()] == [("a.b:80", "de"), ("a.b", "en"), ("src1", ""), (None, None), (None, None), ("a.b", "fr")]


def test_quality_with_labels_of_one_kind(spark, tables):
    got = QUERIES["op8_quality"](spark, tables["full"]).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("which", ["full", "empty"])
def test_pipeline(spark, tables, which):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables[which]}/documents.parquet")
    sizes = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_dir(spark)
        stage(spark, docs, tables[which]).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    out = corpus_pipeline.run(spark, tables[which])
    assert out.columns[:2] == ["doc_id", "piece"] and (out.count() > 0) == (which == "full")
    if which == "full":
        assert sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[4] < sizes[3]


def test_pipeline_stages_keep_the_right_rows(spark, tmp_path):
    """With labels that fit a model: each stage's rows, ids and texts, and the packed result, against plain forms."""
    import corpus_pipeline

    r = random.Random(61)
    vile = ["vilest", "scoundrel", "blackguard"]
    docs = []
    for i in range(600):
        text = prose(r.randint(20, 60), r).split()
        if i % 4 == 0:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(vile))
        docs.append((i, " ".join(text)))
    base, passage, item = prose(90, r), "é" + prose(60, r), prose(30, r)
    docs += [(700, base), (701, f"{base} end"), (702, base), (702, prose(40, r)), (703, f"{prose(50, r)} {passage} {prose(50, r)}"), (704, f"{prose(50, r)} É{passage} {prose(50, r)}")]
    docs += [(710, f"{prose(30, r)} {' '.join(item.split()[5:17])} {prose(30, r)}"), (711, ""), (712, None), (None, prose(30, r))]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(600) if i % 3]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(i, t, "en", f"src{i}", None if t is None else len(t)) for i, t in docs], SCHEMA, "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write([(1, item)], "item_id long, text string", "benchmark")
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert model.weights is not None
    ordinary = [d for d in docs if model.score(d[1]) < 0.5]
    bad = [d for d in docs if d[0] is not None and d[0] < 600 and d[0] % 4 == 0]
    assert sum(d in ordinary for d in bad) <= 0.03 * len(bad) and sum(d in ordinary for d in docs if d not in bad) >= 0.97 * (len(docs) - len(bad))
    single = brute.one_of_each(ordinary, 5, 80, 100)
    left = brute.texts_left(single)
    dirty = {i for i, *_, hit in brute.contamination(left, [(1, item)]) if hit}
    clean = [d for d in left if d[0] not in dirty]
    wanted = {"toxicity": ordinary, "near_duplicates": single, "repeated_passages": left, "decontamination": clean}
    assert len(docs) > len(ordinary) > len(single) and left != single and len(clean) < len(left) == len(single) and dirty == {710}
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_dir(spark)
        stage(spark, at, str(tmp_path)).write.parquet(path)
        at = spark.read.parquet(path)
        assert rows(at, "doc_id", "text") == sorted(wanted[name], key=repr), name
        assert all(x["source"] == f"src{x['doc_id']}" for x in at.collect())
        assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in at.collect())
    encode, pieces = packing.encoder(packing.tokenizer_path()), []
    for i, t in clean:
        ids = np.append(encode(t or ""), 0).astype("<u4")
        pieces += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 2048))]
    assert sorted((tuple(x)[:5] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(pieces, key=repr)
