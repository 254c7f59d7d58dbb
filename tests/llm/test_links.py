"""The n-gram join, fingerprint classes and the pipeline against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from quarryframe.llm import common, minhash, mixing, ngram_join, quality, secrets


def shingles(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, n, threshold):
    """{doc_id: (size, component)} by all pairs of distinct sets."""
    sets = [shingles(t, n) for _, t in rows]
    every = list(set(sets) - {frozenset()})
    group = {s: i for i, s in enumerate(every)}
    for i, a in enumerate(every):
        for b in every[:i]:
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b) and group[a] != group[b]:
                old, new = group[a], group[b]
                for s in every:
                    if group[s] == old:
                        group[s] = new
    least = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            least[group[s]] = min(least.get(group[s], d), d)
    return sorted(((d, len(s), least.get(group[s]) if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, groups=6, size=40):
    """Groups of drifting near copies, exact copies, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 5000))
    texts = ["", " \t", None, "one", "ONE", "one two", "one two three four", "one two three four five", "x y z " * 50]
    passage = [word() for _ in range(30)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 15, 40, 120, 400]))]
        if g % 2:
            base[3:3] = passage
        texts.append(" ".join(base))
        now = list(base)
        for i in range(size):
            if i % 5 == 0:
                now = list(base)
            now[rng.randrange(len(now))] = word()
            texts.append(" ".join(now))
            if i % 7 == 0:
                texts.append(" ".join(now).upper())
    rng.shuffle(texts)
    return [(3 * i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "null id only here"), (6, texts[2]), (9, texts[11])]


@pytest.mark.parametrize(("n", "threshold", "seed"), [(3, Fraction(9, 10), 1), (5, Fraction(4, 5), 2)])
def test_join_brute_force(spark, n, threshold, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "keys": F.lit(0)}).repartition(3)
    got = sorted((tuple(r) for r in ngram_join.linked(df, n, threshold).collect()), key=str)
    assert got == brute(rows, n, threshold)


def test_join_cut_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_BLOCK", 5)
    rows = corpus(3, groups=3)
    got = sorted((tuple(r) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10)).collect()), key=str)
    assert got == brute(rows, 3, Fraction(9, 10))


def test_null_id_bridge(spark):
    """A null id's text between two others: its links hold, and it takes their name."""
    words = [f"w{i}" for i in range(200)]
    a, n, b = (" ".join([*words[:k], *(f"x{i}" for i in range(10 - k // 20))]) for k in (200, 196, 192))
    rows = [(5, a), (None, n), (9, b), (None, "only null ids here"), (None, "only null ids here")]
    got = sorted((tuple(r) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10)).collect()), key=str)
    assert got == brute(rows, 3, Fraction(9, 10))
    assert {r[2] for r in got if r[0] in (5, 9)} == {5}


def test_pairs_are_few(spark, monkeypatch):
    """Unlinked near copies that share very many cells are named once; cells with the same nodes are one."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(600)]
    texts = [" ".join(w if i % 25 else f"d{d}x{i}" for i, w in enumerate(base)) for d in range(12)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, plain = [], ngram_join._tree_pairs

    def counted(members, threshold, nearest):
        pairs = plain(members, threshold, nearest)
        seen.append(pairs.select("a", "b").distinct().count())
        assert seen[-1] == pairs.count()
        return pairs

    monkeypatch.setattr(ngram_join, "_tree_pairs", counted)
    got = sorted((tuple(r) for r in ngram_join.linked(df, 3, Fraction(4, 5)).collect()), key=str)
    assert got == brute(list(enumerate(texts)), 3, Fraction(4, 5))
    assert seen and all(pairs <= 66 for pairs in seen)


def test_first_met():
    rng = np.random.default_rng(2)
    keys = [np.sort(rng.choice(60, int(rng.integers(1, 30)), replace=False)) for _ in range(40)]
    early = np.full((40, ngram_join.EARLY), np.iinfo(np.int64).max)
    for row, k in enumerate(keys):
        early[row, : min(len(k), ngram_join.EARLY)] = k[: ngram_join.EARLY]
    for i in range(40):
        for j in range(i):
            shared = np.intersect1d(keys[i], keys[j])
            told = np.intersect1d(keys[i][: ngram_join.EARLY], keys[j][: ngram_join.EARLY])
            named = [k for k in shared if ngram_join.first_met(early, np.full(40, k), np.array([i]), np.array([j]))[0]]
            assert named == (list(shared[:1]) if len(told) else list(shared))


def test_join_empty(spark):
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string"), 3, Fraction(9, 10)).count() == 0


def test_cells_lose_no_link():
    """Sets at the edge of the threshold always share a cell."""
    rng = np.random.default_rng(0)
    for threshold in (Fraction(9, 10), Fraction(4, 5)):
        slices = ngram_join.Slices(threshold)
        for _ in range(400):
            size = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = a.copy()
            while True:  # as far apart as the threshold allows
                c = np.unique(np.concatenate([b[rng.permutation(len(b))[: len(b) - int(rng.integers(0, 2))]], rng.integers(0, 1 << 63, int(rng.integers(0, 2)), dtype=np.uint64)]))
                same = len(np.intersect1d(a, c))
                if same < threshold * (len(a) + len(c) - same) or rng.random() < 0.02:
                    break
                b = c
            assert set(slices.keys(a).tolist()) & set(slices.keys(b).tolist())


def test_tree_is_exact():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (150, ngram_join.GROUPS)).astype(np.int32)  # three levels of nodes
    points[50:] = np.maximum(points[rng.integers(0, 50, 100)] - (rng.random((100, ngram_join.GROUPS)) < 0.05), 0)
    sizes, labels, t = points.sum(axis=1), rng.integers(0, 20, 150), Fraction(9, 10)
    got = {tuple(sorted(p)) for i, j in ngram_join.Tree(points, sizes).pairs(labels, t) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if labels[i] != labels[j] and 19 * np.minimum(points[i], points[j]).sum() >= 9 * (sizes[i] + sizes[j])}
    assert got == want
    halves = rng.integers(0, 2, 150)
    got = {tuple(sorted(p)) for i, j in ngram_join.Tree(points, sizes).pairs(labels, t, halves) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i, j in want if halves[i] != halves[j]}


def test_points_keep_every_token():
    tokens = np.unique(np.random.default_rng(4).integers(0, 1 << 50, 40_000, dtype=np.uint64))  # crowded into few ranges
    assert ngram_join.point(tokens).sum() == len(tokens)


@pytest.mark.parametrize("most", [200_000, 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "EDGES_A_TASK", most)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (100, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100, 102: 100}


def test_fingerprint_classes(spark):
    rows = corpus(4, groups=4, size=25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows, 5, Fraction(4, 5))


def test_fingerprint_query_gives_the_classes(spark):
    """near_id through the query's own path, against all pairs; a hot band, one id with two texts, null ids."""
    rows = corpus(7, groups=3, size=15) + [(6000 + i, "the same crowd of words in one hot band") for i in range(60)]
    got = minhash.with_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"text_key": F.lit("clash"), "near_id": F.lit(0)}), parts=3).collect()
    want = brute(rows, 5, Fraction(4, 5))
    assert sorted(((r["doc_id"], r["near_id"]) for r in got), key=str) == sorted(((d, c) for d, _, c in want), key=str)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = common.materialise(corpus_pipeline.keep_quality(spark, docs, SF))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    right = [(d in ids) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.9 * len(right)

    one = common.materialise(corpus_pipeline.drop_near_duplicates(spark, kept, SF))
    expected = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in kept.collect()], 5, Fraction(4, 5)) if d == c}
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(expected)

    masked = common.materialise(corpus_pipeline.mask_secrets(spark, one, SF))
    assert masked.columns == docs.columns and masked.count() == one.count()
    for r in masked.collect():
        assert secrets.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])

    mixed = common.materialise(corpus_pipeline.mix_sources(spark, masked, SF))
    assert mixed.columns == docs.columns
    plan = {r["doc_id"]: r["__mix_copies"] for r in mixing.allocate(masked).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in plan.items() if n}

    encoded = corpus_pipeline.encode(spark, mixed, SF)
    assert encoded.count() == mixed.count() and encoded.where("not exact or n_tokens <> size(ids)").count() == 0


def test_pipeline_ids_and_names(spark):
    """One id with two texts, repeated rows, null ids, and columns named as the stages name theirs."""
    def text(seed):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60))

    rows = [(1, text(1), 1), (1, text(2), 2), (2, text(3), 3), (2, text(3), 3), (2, text(3), 4), (3, text(1), 5), (None, text(2), 6), (None, text(4), 7), (None, text(4), 7), (4, None, 8), (4, " ", 9)]
    names = ["__quality", "__kept", "row", "id", "key", "worded", "times", "__copy", "__mix_n", "_id", "score", "y", "w"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").withColumns({n: F.lit(n) for n in names}).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "m": F.create_map(F.lit("a"), F.col("place"))})
    one = common.materialise(corpus_pipeline.drop_near_duplicates(spark, docs, SF))
    assert one.columns == docs.columns
    assert sorted(r["place"] for r in one.collect()) == [1, 2, 3, 7, 8, 9]
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "secrets", "mixing"):
        assert stages[name](spark, one, SF).columns == docs.columns
    assert stages["encoding"](spark, one, SF).count() == 6
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A b c d e f g", None, None, 13), (None, "no id", "en", "s", 5), (3, None, "en", "s", None), (4, "", "de", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "3", "4", "None"]
    assert corpus_pipeline.mask_secrets(spark, docs, SF).count() == 6
    assert corpus_pipeline.keep_quality(spark, docs.limit(0), SF).count() == 0
    assert quality.N_STATS == quality.statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
