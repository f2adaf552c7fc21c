"""The ten operators and the pipeline's stages: brute force, exact round trips, held-out accuracy, and awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boscage.llm import ann, bpe, chat, embdedup, langid, licenses, lm, minhash, packing, quality
from boscage.llm._common import components, remainder, scanned
from boscage.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.test_queries import same

SF = "/root/testdata/sf0.001"
LONG = "zebra stripes " * 30_000
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "A B  c d e\nf g"), (None, "kept text of its own"), (7, LONG), (8, "x<|endoftext|>y it's 12 Ünïcode ΑΣ ΟΔΟΣ"), (9, "...!!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    same(spark, QUERIES, ORACLE_SQL, name)


def test_chat_reads_back_awkward_texts(spark):
    rows = [(-2, 0, "user", "a\\<\\|b"), (-2, 1, "user", "<|<||im_next|>"), (-2, None, "r\n<|nl|>\\n", ""), (-2, 5, "assistant", None), (-2, 5, "assistant", None), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert chat.digest(chat.format_chats(df.where("false"))).count() == 0


def test_bpe_equals_the_library(spark, docs, empty):
    t = hf()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, tokenizer_path()).collect())
    want = Counter()
    for i, text in AWKWARD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want and bpe.round_trip(empty, tokenizer_path()).count() == 0
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()}
    assert texts[8] == t.decode(t.encode(AWKWARD[8][1], add_special_tokens=False).ids, skip_special_tokens=False)


def _thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_whose_power_sums_agree(spark, n):
    """Such a word and its complement have equal sums of powers modulo 2**64: tokens, counts and shingle sets keep them apart."""
    one, two = _thue_morse(n)
    t, c = hf(), bpe.Codec(tokenizer_path())
    ids, counts = c.encode([one, two, f"x {two} {one}"])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in (one, two, f"x {two} {one}")]
    df = spark.createDataFrame([(0, one), (1, two), (2, two)], "doc_id long, text string")
    m = lm.train(df.where("doc_id = 0"), F.lit(True))
    assert {r["doc_id"]: r["n_known"] for r in lm.scores(df, m).collect()} == {0: 2, 1: 1, 2: 1}
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 1}


def test_bpe_compares_letters_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(bpe, "span_hash", lambda values, start, end: (end - start).astype("u8") % np.uint64(3))
    t, c = hf(), bpe.Codec(tokenizer_path())
    texts = [x or "" for _, x in AWKWARD] + ["to be or not to be", "a b c", "tea bee sea"]
    for _ in range(2):
        ids, counts = c.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def _check_packed(rows, texts, capacity):
    t = hf()
    want = Counter()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[(i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= capacity
    return len(at)


def test_packing(spark, docs, empty):
    _check_packed(packing.pack(docs, tokenizer_path(), 64).collect(), AWKWARD, 64)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(real.repartition(20), tokenizer_path()).collect()
    n = _check_packed(rows, [(r["doc_id"], r["text"]) for r in real.collect()], 4096)
    best = packing.best_fit(np.array([r["length"] for r in rows]), 4096).max() + 1
    assert n <= 1.05 * best + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


def _groups(texts):
    sets = {}
    for k, t in enumerate(texts):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if x]
        if w:
            sets[k] = frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)])
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_against_brute_force(spark, docs, empty):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    base = [f"w{i}" for i in range(60)]
    made = [(100_000 + k, " ".join(base[:j] + [f"c{k}"] + base[j:])) for k, j in enumerate([*range(0, 60, 1), 5, 5])]
    rows = [tuple(r) for r in real.collect()] + made
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = _groups([t for _, t in rows])
    names = {rows[k][0]: rows[g][0] for k, g in enumerate(want)}
    assert {r["doc_id"]: r["component_id"] for r in got} == names
    assert sum(r["kept"] for r in got) == len(set(want))
    kept = [r["doc_id"] for r in minhash.keep(docs).collect()]
    assert kept.count(4) == 1 and 5 not in kept and {1, 2, 3, 7, 8, 9, None} <= set(kept)
    assert minhash.near_duplicates(empty).count() == 0


def test_rows_of_files_are_numbered_in_place(spark, tmp_path):
    rows = [(k // 2, f"one two three four five six {k // 4}", k) for k in range(40)] + [(None, None, 40), (None, "", 41)]
    spark.createDataFrame(rows, "doc_id long, text string, more int").repartition(5).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert scanned(read) and scanned(read.where("more >= 0").select("doc_id", "text"))
    assert not scanned(read.union(read)) and not scanned(read.where("rand() < 2")) and not scanned(read.withColumn("_metadata", read.more))
    numbered, _ = minhash._numbered(read)
    assert numbered.select(minhash.ROW).distinct().count() == len(rows) and numbered.drop(minhash.ROW).columns == read.columns
    kept = minhash.keep(read).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == list(range(0, 20, 2)) and sum(r["doc_id"] is None for r in kept) == 2
    twice = minhash.keep(read.union(read))
    assert twice.count() == 14 and twice.columns == read.columns


@pytest.mark.parametrize("far", [False, True])
def test_wide_buckets_are_compared_whole(spark, monkeypatch, far):
    """Wide buckets in blocks and large ones in parts; `far`: everything that is broadcast while it is small is shuffled."""
    for name in ("BROADCAST", "BROADCAST_PAIRS", "FILES") if far else ():
        monkeypatch.setattr(minhash, name, 1)
    monkeypatch.setattr(minhash, "SPLIT", 7)
    monkeypatch.setattr(minhash, "WIDE", 2)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "TURNS", 1)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(80):
        w = list(base)
        for j in rng.choice(120, 2, replace=False):
            w[j] = f"e{k}{j}"
        rows.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(_groups([t for _, t in rows])))


@pytest.mark.parametrize("weighted", [False, True])
def test_weights_are_counts(spark, weighted):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(0, base), (1, f"{base} {base} {base} {base}"), (2, f"{base} {base} {base} {base} {base}"), (3, base + " x")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighted=weighted).collect()}

    def alike(a, b):
        x, y = (Counter(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in (a, b))
        if not weighted:
            x, y = Counter(set(x)), Counter(set(y))
        return sum((x & y).values()) / sum((x | y).values())

    link = [[alike(a, b) >= 0.8 for _, b in rows] for _, a in rows]
    want = list(range(4))
    for _ in range(4):
        want = [min(want[j] for j in range(4) if link[i][j]) for i in range(4)]
    assert got == dict(enumerate(want))
    assert weighted == (want[1] != 0)


def test_darts_estimate_weighted_similarity():
    w, v = np.array([3.5, 1.0, 0.25, 2.0]), np.array([1.5, 2.0, 0.5, 2.0])
    e = np.array([5, 6, 7, 8], "u8")
    s = minhash.dart_minhash(np.concatenate([e, e]), np.repeat([0, 1], 4), np.concatenate([w, v]), 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.04)


VECTORS = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(60, 8)))]
ODD = [(100, None), (101, [0.0] * 8), (102, [float("nan")] + [1.0] * 7), (103, [1.0]), (104, VECTORS[0][1]), (104, VECTORS[0][1]), (105, [2 * x for x in VECTORS[3][1]]), (None, VECTORS[5][1]), (106, [None] + [1.0] * 7)]


def test_vectors(spark):
    df = spark.createDataFrame(VECTORS + ODD, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embdedup.link_groups(df).collect() if r["vec_id"] is not None}
    assert got[0]["n_links"] == 2 and got[104]["component_id"] == 0 and got[105]["component_id"] == 3 and got[105]["n_links"] == 1 and got[5]["n_links"] == 1
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (100, 101, 102, 103, 106))
    assert embdedup.link_groups(df.where("false")).count() == 0
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert found[0][:2] == [(104, 0.0), (104, 0.0)] and set(found) == {0, 20, 40}
    assert ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, 10).count() == 2 and ann.nearest(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize(("flat", "exact", "block"), [(1024, False, 1024), (8, False, 4), (1024, True, 1024)])
def test_links_against_brute_force(spark, monkeypatch, flat, exact, block):
    """Partners made at cosines from 0.90 to 0.92, copies, and a crowd in one list; one or two levels, short blocks, exact rule."""
    for name, value in (("FLAT", flat), ("PER_LIST", 20), ("BLOCK", block), ("BROADCAST", 0 if block == 4 else 200_000)):
        monkeypatch.setattr(embdedup, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(500, 24))
    z -= (z * x[:500]).sum(1, keepdims=True) * x[:500]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.90001, 0.92, (500, 1))
    crowd = x[600] + 0.03 * rng.normal(size=(60, 24))
    x = np.concatenate([x, c * x[:500] + np.sqrt(1 - c * c) * z, crowd, x[:20]]) * rng.uniform(0.5, 2, (1280, 1))
    x[1260:] = x[:20]
    df = spark.createDataFrame([(i, v.tolist(), "clash", i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, list string, node int")
    got = {r["vec_id"]: r for r in embdedup.link_groups(df, 0.9, exact).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= link.sum(1)).all()
    if exact:
        assert (found == link.sum(1)).all()
    assert found.sum() >= 0.99 * link.sum()
    assert (found[1200:1260] == link[1200:1260].sum(1)).all() and all(got[1260 + i]["component_id"] == got[i]["component_id"] for i in range(20))


def test_nearest_beyond_its_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 3)
    monkeypatch.setattr(ann, "RATIO", 1.0)
    monkeypatch.setattr(ann, "FLOOR", 1)
    monkeypatch.setattr(ann, "GROUP", 50)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 8)) * 100, 3, axis=0) + rng.normal(size=(120, 8)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 40 == 0, 119).collect()
    assert len(got) == 3 * 119
    for q in range(0, 120, 40):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(120), d))[:119].tolist()
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_search_recall(spark):
    x = np.random.default_rng(2).normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 300


def test_classifiers(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = remainder("doc_id", 3) == 1
    q = quality.train(d, labels, ~held)
    x = quality.scores(d, q).where(held).join(labels, "doc_id").select("score", "quality").toPandas()
    assert ((x.score >= 0.5) == (x.quality == 1)).mean() > 0.9
    assert quality.scores(docs, q).count() == len(AWKWARD) and quality.keep(docs, q).columns == docs.columns
    m = langid.train(d, remainder("doc_id", 4) != 2)
    x = langid.predictions(d, m).join(d.select("doc_id", "lang"), "doc_id").where(remainder("doc_id", 4) == 2).toPandas()
    assert (x.lang == x.lang_pred).mean() > 0.95 and x.accepted.mean() > 0.99
    p = {r["doc_id"]: r for r in langid.predictions(docs, m).collect()}
    assert all(p[i]["lang_pred"] == "und" and p[i]["score"] == 0 and not p[i]["accepted"] for i in (1, 2, 3, 9))
    assert langid.keep(docs, m).columns == docs.columns
    none = quality.train(d, labels.where("false"), F.lit(True))
    assert quality.scores(docs, none).first()["score"] == 0.5 and langid.predictions(docs, langid.train(empty, F.lit(True))).first()["lang_pred"] == "und"


@pytest.mark.parametrize(("order", "shard", "hold"), [(2, 8 << 20, 3_000_000), (3, 2_000, 3_000), (4, 8 << 20, 3_000_000)])
def test_language_model_against_brute_force(spark, docs, empty, monkeypatch, order, shard, hold):
    """All levels from plain counts; small shards, so that frequent words' tuples are dealt by their own hash."""
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    monkeypatch.setattr(lm, "HOLD", hold)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text").where("doc_id is not null"))
    m = lm.train(d, remainder("doc_id", 5) != 1, order)
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)), b"\0end"]
    one, grams = Counter(), {order: Counter()}
    rows = d.collect()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            w = [b"\0begin"] * (order - 1) + tok(r["text"])
            one.update(w[order - 1 :])
            grams[order].update(zip(*[w[i:] for i in range(order)], strict=False))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    n, v = sum(one.values()), len(one)
    discount = {k: lm._discounts([sum(c == i for c in g.values()) for i in (1, 2, 3, 4)]) for k, g in grams.items()}
    total, few = Counter(), defaultdict(lambda: [0, 0, 0])
    for g in grams.values():
        for t, c in g.items():
            total[t[:-1]] += c
            few[t[:-1]][min(c, 3) - 1] += 1

    def p(before, x):
        k = len(before) + 1
        c, e = grams[k].get((*before, x), 0), discount[k]
        if not before:
            return max(c - e[min(c, 3)], 0) / total[()] + sum(e[i + 1] * few[()][i] for i in range(3)) / total[()] / (v + 1)
        lower = p(before[1:], x)
        return (max(c - e[min(c, 3)], 0) + sum(e[i + 1] * few[before][i] for i in range(3)) * lower) / total[before] if total[before] else lower

    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in lm.scores(d, m).collect())
    want = Counter()
    for r in rows:
        w = [b"\0begin"] * (order - 1) + tok(r["text"])
        s = sum(np.log10(p(tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w)))
        own = w[order - 1 :]
        want[(r["doc_id"], len(own), sum(one[x] > 0 for x in own), n, round(sum(np.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), 4), round(s, 4))] += 1
    assert sum((got - want).values()) <= 2  # rounding at the fourth digit
    bare = lm.train(empty, F.lit(True), order)
    assert lm.scores(docs, bare).count() == len(AWKWARD) and lm.scores(empty, bare).count() == 0


def test_language_model_counts_are_64_bit(spark):
    keys, count = np.array([3, 9, 1 << 62], "u8"), np.array([1, 1 << 40, 7], "u8")
    assert all((x == y).all() for x, y in zip(lm.unpack(lm.pack(keys, count)), (keys, count), strict=True))
    huge = [np.array([5, 5, 1 << 33]), np.array([1 << 34, 1 << 34, 2])]
    assert len(np.unique(lm.chained(huge))) == 2
    folder = "file:" + lm.shared_dir(spark)
    for _ in range(2):  # a second attempt
        lm.save(folder, "x", [keys, count, np.array([1, 2, 3]), np.zeros(0, "u8")])
    assert [x.tolist() for x in lm.mapped(folder, "x")] == [keys.tolist(), count.tolist(), [1, 2, 3], []]
    rng = np.random.default_rng(6)
    many, value = rng.integers(0, 1 << 64, 5000, dtype="u8"), rng.integers(0, 1 << 50, 5000)
    own = np.sort(many[:4000])
    some = lm.stored(own, [value[:4000], value[:4000] % 7])
    got = lm.looked_up(some, np.concatenate([own, many[4000:]]))
    assert got[0].tolist() == [*value[:4000].tolist(), *[0] * 1000] and got[1].tolist() == [*(value[:4000] % 7).tolist(), *[0] * 1000]


def test_licence_rules(spark, docs):
    text = 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this\nThe above copyright notice and this permission notice shall be included in all\ncopies\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n'
    df = spark.createDataFrame([(1, text), (2, "All rights reserved. All rights reserved!"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in licenses.scan(df).collect()) == [(1, "MIT", 0, 6), (2, "Proprietary", 0, 0), (2, "Proprietary", 1, 1)]
    assert licenses.scan(docs).count() == 0


def test_licences_as_published(spark):
    texts = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "SPDX-License-Identifier: MIT-0", "This project is licensed under the MIT License - see LICENSE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r[0], r[1]) for r in licenses.scan(df).collect()} == {(0, "MIT"), (1, "Apache-2.0"), (2, "GPL-3.0"), (3, "MPL-2.0"), (5, "MIT")}
    every = [(i, s) for i, s in enumerate(licenses.SENTENCES.values())]
    seen = spark.createDataFrame(every, "doc_id long, text string").where(licenses.anchored(F.col("text"))).select("doc_id", licenses.known_sentences(F.col("text"))["code"]).collect()
    assert {r[0]: r[1] for r in seen} == {i: [i + 1] for i, _ in every}
    stated = [(i, ". ".join(licenses.SENTENCES[n] for n in names)) for i, (_, names) in enumerate(licenses.RULES)]
    found = {(r[0], r[1]) for r in licenses.scan(spark.createDataFrame(stated, "doc_id long, text string")).collect()}
    assert {(i, x) for i, (x, _) in enumerate(licenses.RULES)} <= found


MIT = """MIT License

Copyright (c) 2020 Some Body. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_licences_in_any_wrapping(spark):
    import textwrap

    texts, want = [], []
    for name, whole, begins, ends in (("MIT", MIT, "mit license", "and noninfringement"), ("BSD", BSD, "redistribution and", "following disclaimer"), ("Apache-2.0", APACHE, "licensed under", "the license at")):
        for width in (0, 40, 72, 100):
            for lead in ("", " * ", "# "):
                lines = [w for part in whole.split("\n") for w in ((textwrap.wrap(part, width) if width else [part]) or [""])]
                texts.append((len(texts), "\n".join(lead + x for x in lines)))
                want.append((name, begins, ends))
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got[r[0]].add(tuple(r)[1:])
    for (i, text), (name, begins, ends) in zip(texts, want, strict=True):
        cut = [re.sub(licenses.OTHER, " ", x).strip() for x in re.sub(licenses.CUT.replace(r"\z", r"\Z"), "\n", text.lower()).split("\n")]
        found = [x for x in got[i] if x[0] == name]
        assert len(found) == 1 and begins.split()[0] in cut[found[0][1]], (i, text)
        assert " ".join(cut[found[0][2] - 3 : found[0][2] + 1]).rstrip(".").endswith(ends) and found[0][2] > found[0][1], (i, text)


BSD3 = BSD + """

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
ISC = """ISC License

Copyright 2020 Some Body

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
GRANT = MIT.split("\n\n")[2]
STATED = {"MIT": [MIT, GRANT, "SPDX-License-Identifier: MIT"], "BSD": [BSD.split("\n\n")[1]], "BSD-3-Clause": [BSD3], "BSD-2-Clause": [BSD3.split("\n\n3.")[0]], "GPL-3.0": [GPL3], "ISC": [ISC], "Zlib": [ZLIB], "Apache-2.0": [APACHE, "SPDX-License-Identifier: Apache-2.0"], "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999"], "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."]}


def test_each_licence_is_found_once_in_spark_and_sql(spark):
    """Whole texts and single statements, in paragraphs of one line and wrapped, give one match each; SQL finds the same."""
    import textwrap

    import duckdb

    rows, want = [(10_000, None), (10_001, ""), (10_002, "no rights, no licence"), (10_004, "redistributions of source code must retain the above copyright notice and this permission notice shall be included in all rights reserved"), (10_003, ("words " * 40_000) + "SPDX-License-Identifier: ISC")], [(10_003, "ISC"), (10_004, "Proprietary")]
    for name, texts in STATED.items():
        for whole in texts:
            for width in (0, 40, 80):
                for lead in ("", "// "):
                    lines = [w for part in whole.split("\n") for w in ((textwrap.wrap(part, width) if width else [part]) or [""])]
                    want.append((len(rows), name))
                    rows.append((len(rows), "\n".join(lead + x for x in lines)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(documents).collect())
    assert [x[:2] for x in got] == sorted(want)
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    assert sorted(con.execute(licenses.ORACLE).fetchall()) == got


def test_scores_against_plain_sums(spark, docs, empty):
    """Operators 6 and 7 word by word: the mean of subwords' logits under a softmax, the sum of n-grams' weights under a sigmoid."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 = 0")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [*AWKWARD, *((r["doc_id"], r["text"]) for r in d.limit(20).collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    q = quality.train(d, labels, F.lit(True))
    want = Counter()
    for i, text in rows:
        raw = (text or "").encode()
        bucket, _, tokens = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        z = q.bias
        for b in bucket.tolist():
            z += float(q.weights[b]) * quality.SCALE / max(1, int(tokens[0]))
        want[(i, round(1 / (1 + np.exp(-z)), 5))] += 1
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in quality.scores(df, q).collect()) == want
    m = langid.train(d, F.lit(True))
    want = Counter()
    for i, text in rows:
        bucket, _ = langid.subwords([text])
        if not len(bucket):
            want[(i, "und", 0.0)] += 1
            continue
        z = sum(m.logits[b].astype(float) for b in bucket.tolist()) / len(bucket)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want[(i, m.langs[int(p.argmax())], round(float(p.max()), 4))] += 1
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in langid.predictions(df, m).collect()) == want
    assert quality.scores(empty, q).count() == 0 and langid.predictions(empty, m).count() == 0
    twice = df.union(df)
    assert len({r["score"] for r in quality.scores(twice.where("doc_id = 7"), q).collect()}) == 1


COLUMNS = {
    "op1_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_minhash_dedup": ["doc_id", "class_id", "component_id", "kept"],
    "op4_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_license_scan": ["doc_id", "license", "first_sentence", "last_sentence"],
    "op10_nearest": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries(spark, name):
    """Every query over its whole table: columns in order, one row a document or vector, folds by the remainder."""
    got = QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.collect()
    whole = {"op5_embedding_dedup": "embeddings", "op10_nearest": "embeddings", "op1_chat_formatting": "conversations"}.get(name, "documents")
    key = {"embeddings": "vec_id", "conversations": "conv_id"}.get(whole, "doc_id")
    ids = Counter(r[key] for r in spark.read.parquet(f"{SF}/{whole}.parquet").select(key).collect())
    if name in ("op3_minhash_dedup", "op4_bpe_round_trip", "op5_embedding_dedup", "op6_language_id", "op7_quality", "op8_lm_scoring"):
        assert Counter(r[key] for r in rows) == ids
    elif name == "op2_best_fit_packing":
        assert {r["doc_id"] for r in rows} == set(ids)
    elif name == "op10_nearest":
        assert Counter(r["query_id"] for r in rows) == {i: 10 for i in ids if i % 100 == 0}
        assert all(r["vec_id"] != r["query_id"] for r in rows)
    elif name == "op1_chat_formatting":
        assert {r["conv_id"] for r in rows} == {*ids, -1}
    folds = {"op6_language_id": (4, 2), "op7_quality": (3, 1), "op8_lm_scoring": (5, 1)}
    if name in folds:
        mod, held = folds[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == held) for r in rows)
    if name == "op7_quality":
        assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_awkward_tables_of_every_kind(spark, docs, empty):
    """Long chats, clashing columns, empty tables, ties and repeats where other tests don't have them."""
    long = spark.createDataFrame([(1, k, "assistant" if k % 3 else "user", f"say {k} " * 200, "clash") for k in range(400)], "conv_id long, turn long, role string, text string, formatted string")
    r = chat.digest(chat.format_chats(long)).first()
    assert r["n_turns"] == 400 and r["loss_chars"] == sum(len(f"say {k} " * 200) for k in range(400) if k % 3)
    assert licenses.scan(empty).count() == 0
    same_size = spark.createDataFrame([(i // 2, "one two three") for i in range(50)], "doc_id long, text string")
    _check_packed(packing.pack(same_size, tokenizer_path(), 16).collect(), [(i // 2, "one two three") for i in range(50)], 16)
    df = spark.createDataFrame([(i, [float(i % 5 == j) for j in range(5)], i, i, "x") for i in range(25)], "vec_id long, embedding array<double>, list int, rid long, node string")
    ties = embdedup.link_groups(df).collect()
    assert all(r["n_links"] == 4 and r["component_id"] == r["vec_id"] % 5 for r in ties)
    near = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 0, 6).orderBy("rank").collect()]
    assert near == [5, 10, 15, 20, 1, 2]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as c

    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_components(spark, tmp_path):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (2, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path))
    assert {r["node"]: r["component"] for r in got.collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now = docs
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, SF).persist()
        assert now.columns == docs.columns
        if name == "quality":
            bad = labels.where("quality = 0").join(now, "doc_id").count()
            assert bad <= 0.1 * labels.where("quality = 0").count()
    groups = _groups([r["text"] for r in now.collect()])
    assert len(set(groups)) == len(groups)
    packed = c.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == now.count()
