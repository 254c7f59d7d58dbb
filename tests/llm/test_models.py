"""Classifiers by held-out accuracy; top-k, chat, mixing and fingerprints by brute force."""

import hashlib
import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.llm import chat, common, minhash, mixing, quality, queries, topk, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, duck, name):
    assert oracle.differences(queries.QUERIES[name](spark, SF), duck, queries.SQL[name]) == ""


def held_out(spark, query, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = [(r, labels[r["doc_id"]]) for r in query(spark, SMALL).collect() if r["held_out"] and r["doc_id"] in labels]
    assert rows and all(0 <= r["score"] <= 1 for r, _ in rows)
    return rows


def test_quality_held_out(spark):
    rows = held_out(spark, quality.query, "quality")
    assert sum(r["predicted"] == y for r, y in rows) >= 0.95 * len(rows)


def test_toxicity_held_out(spark):
    rows = held_out(spark, toxicity.query, "toxic")
    assert sum(r["predicted"] == y for r, y in rows) >= 0.93 * len(rows)


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, quality.train(common.labelled_sample(docs, none, "quality", 100))).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}


def test_sample_is_bounded_and_never_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    sample = common.labelled_sample(docs, labels, "quality", 40)
    assert sample.count() == 40 and sample.where(common.fold("doc_id", 3) == 1).count() == 0


def test_sample_holds_its_bounds_with_repeated_ids(spark):
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = labels.crossJoin(spark.range(200).select(F.col("id").alias("n"))).select("doc_id", F.concat(F.lit("text "), F.col("n")).alias("text"), F.lit(1).alias("_id"), F.lit(2).alias("y"))
    assert common.labelled_sample(docs, labels, "quality", 10).count() == 10
    usable = labels.where(common.fold("doc_id", 3) != 1).count()
    few = common.labelled_sample(docs, labels, "quality", 1000, 0, 80).collect()
    assert 0 < len(few) < usable and sum(len(r["text"]) for r in few) <= 80
    assert sum(r["w"] for r in few) == pytest.approx(usable)


def test_quality_keeps_the_share_of_classes(spark):
    # one text says nothing, so its score is the share of good labels, also where the bound cuts the larger class
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("the same plain words").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 6 != 0).cast("int").alias("quality"))
    usable = labels.where(common.fold("doc_id", 3) != 1)
    share = usable.agg(F.avg("quality")).first()[0]
    sample = common.labelled_sample(docs, labels, "quality", 200)
    weights = {r["y"]: r["w"] for r in sample.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    assert weights == pytest.approx({r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()})
    (score,) = {r["score"] for r in quality.score(docs.limit(3), quality.train(sample)).collect()}
    assert abs(score - share) < 0.1


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    vectors = rng.random((300, 20)) * (rng.random((300, 20)) < 0.2)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    index = toxicity.Index(vectors, np.zeros(300), list(range(300)))
    for q in vectors[:50]:
        terms = np.flatnonzero(q)
        sims, rows = index.nearest(terms, q[terms], 7)
        every = np.round(index.vectors @ q, 9)
        best = sorted((-s, i) for i, s in enumerate(every) if s > 0)[:7]
        assert [(-s, i) for s, i in zip(sims, rows, strict=True)] == best


def test_block_bounds_lose_no_neighbour():
    """Examples of ten subjects, gathered into blocks, most of which a search passes over; ties over blocks and rows without terms."""
    rng = np.random.default_rng(4)
    subject = rng.integers(0, 10, 1500)
    vectors = rng.random((1500, 400)) * (rng.random((1500, 400)) < 0.02) * 0.3
    vectors[np.arange(1500)[:, None], subject[:, None] * 40 + rng.integers(0, 40, (1500, 8))] += 1
    vectors[:60] = vectors[0]
    vectors[60:70] = 0
    vectors[:, 0] += 0.01  # a common term
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    order = toxicity.gathered(toxicity.Sparse.of(vectors))
    assert sorted(order) == list(range(1500))
    vectors = vectors[order]
    index, queries = toxicity.Index(vectors, np.zeros(1500), list(range(1500))), rng.permutation(1500)[:200]
    seen = []
    add = index._add
    index._add = lambda found, blocks, *rest: (seen.append(blocks.sum()), add(found, blocks, *rest))
    for q, (sims, rows) in zip(queries, index.search(toxicity.Sparse.of(vectors[queries])), strict=True):
        every = np.round(vectors @ vectors[q], 9)
        best = np.lexsort((np.arange(1500), -every))[: toxicity.NEIGHBOURS]
        assert np.allclose(sims, every[best], atol=2e-9) and np.allclose(every[rows], every[best], atol=2e-9)
    assert sum(seen) < 0.5 * 200 * len(index.starts)


def test_toxicity_is_the_vote_of_all_examples(spark):
    """The query's scores against a plain cosine over every example, with equal texts, ties, nulls and clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "zzzz qqqq"), (None, "the words"), (-4, "the words")], "doc_id long, text string")
    docs = docs.union(odd).withColumns({"score": F.lit("clash"), "evidence": F.lit(1), "y": F.lit(2)})
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    index, place = model["index"], {int(h): i for i, h in enumerate(model["vocabulary"])}
    examples = np.zeros((len(index.labels), len(place)))
    v = index.vectors
    examples[v.owners(), v.cols] = v.values
    got = [r for r in toxicity.score(docs, model).collect()]
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    scores = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(texts) and scores[None] == scores[-4] and scores[-1] == scores[-2] == scores[-3]
    for doc, text in random.Random(1).sample(texts, 80):
        q = np.zeros(len(place))
        hashes, _ = toxicity.terms(*common.raw(common.as_texts(pa.array([text]))))
        for h, n in Counter(hashes.tolist()).items():
            if h in place:
                q[place[h]] = (1 + np.log(n)) * model["weight"][place[h]]
        if q.any():
            q /= np.linalg.norm(q)
        sims = np.round(examples @ q, 9)
        near = sorted((-s, i) for i, s in enumerate(sims) if s > 0)[: toxicity.NEIGHBOURS]
        share = round(sum(s * s * index.labels[i] for s, i in near) / sum(s * s for s, _ in near), 9) if near else -1.0
        assert scores[doc] == pytest.approx(float(np.clip(np.interp(share, *model["knots"]), 0, 1)), abs=1e-6)


def test_quality_approaches_kernel_ridge(spark):
    """Random features against ridge regression with the Gaussian kernel itself, and scores of odd texts."""
    rng = np.random.default_rng(5)
    stats = rng.normal(size=(120, quality.N_STATS))
    waves = quality._waves(stats, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))[:, :-1]
    far = ((stats[:, None] - stats[None]) ** 2).sum(axis=2)
    kernel = np.exp(-far / (2 * quality.N_STATS))
    assert np.abs(waves @ waves.T - kernel).max() < 6 / np.sqrt(quality.FEATURES)
    y = (stats[:, 0] > 0).astype(float)
    exact = kernel @ np.linalg.solve(kernel + quality.RIDGE * np.eye(120), y)
    near = waves @ np.linalg.solve(waves.T @ waves + quality.RIDGE * np.eye(quality.FEATURES), waves.T @ y)
    assert np.corrcoef(exact, near)[0, 1] > 0.9
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(common.labelled_sample(docs, labels, "quality", 400))
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "word " * 200_000)], "doc_id long, text string").withColumns({"y": F.lit(1), "stats": F.lit("x")})
    scores = {r["doc_id"]: r["score"] for r in quality.score(odd, model).collect()}
    assert scores[1] == scores[2] and all(0 <= x <= 1 for x in scores.values())


def test_toxicity_weighs_all_terms_of_both_labels(spark):
    rows = [(i, f"alpha{i} beta{i % 9} gamma{i % 5} delta{i % 7} zeta{i % 11}" + " vile" * (i % 3 == 0), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "gamma3 alone"), (1001, "no sampled term")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    index, usable = model["index"], labels.where(common.fold("doc_id", 3) != 1)
    fit = usable.count() - usable.count() // 4
    assert len(index.labels) == fit and 0 < index.labels.sum() < fit and (model["weight"] > 0).all()
    words = {w for r in usable.join(docs, "doc_id").collect() for w in r["text"].split()}
    assert len(model["vocabulary"]) == len(words)
    proof = {r["doc_id"]: r["evidence"] for r in toxicity.score(docs, model).collect()}
    assert proof[1000] and not proof[1001]
    assert all(f"gamma{int(e.split(':')[0]) % 5}" == "gamma3" for e in proof[1000].split(","))


def test_topk_brute_force(spark):
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(90)]
    data += [(200 + i, [rng.choice([1e6, -1e6, 3e-5, 0.5]) * (j == i % 6) for j in range(6)]) for i in range(12)]  # products stay within 64 bits
    data += [(140, [1e300, 0.0]), (160, [0.0] * 6 + [-1e12]), (161, [0.0] * 6 + [-0.5]), (162, [0.0] * 6 + [7.0]), (180, [0.25] * 6), (180, [0.25] * 6), (180, [0.25] * 5 + [0.0, 0.0]), (180, [0.25] * 5)]
    data += [(7, data[7][1]), (40, data[40][1]), (100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (None, [0.5] * 6), (104, []), (120, [0.25, 0.5])]
    df = spark.createDataFrame(data, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), ])).withColumn("score", F.lit("clash"))
    rows = topk.integer_vectors(df.where("vec_id is null or vec_id <> 140"))
    got = sorted(tuple(r) for r in topk.search(rows, rows.where("vec_id % 20 = 0"), 5).collect())
    with pytest.raises(Exception, match="a score beyond 64 bits"):
        topk.search(topk.integer_vectors(df), topk.integer_vectors(df.where("vec_id = 140")), 5).collect()
    clean = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in data if i is not None and i != 140 and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for a, (i, v) in enumerate(clean):
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(clean) if a != b)[:5]  # noqa: B905
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert got == sorted(expected)
    assert topk.search(rows.limit(0), rows.limit(0)).count() == 0


def test_topk_sees_a_hot_row_once(spark):
    """A vector that half of the rows repeat is one row of a shard, and so many candidates."""
    df = spark.createDataFrame([(20, [0.5, 0.25])] * 300 + [(i, [i / 4000, 0.1]) for i in range(300)], "vec_id long, embedding array<double>")
    rows = topk.integer_vectors(df)
    got = topk.search(rows, rows.where("vec_id = 20"), 5).collect()
    assert len(got) == 5 * 301 and sum(r["vec_id"] == 20 and r["rank"] == 5 for r in got) >= 300


def test_topk_prunes(monkeypatch):
    rng = np.random.default_rng(0)
    weights = np.zeros((4000, 8), np.int64)
    weights[np.arange(4000), rng.integers(0, 8, 4000)] = rng.integers(1, 50, 4000)
    shard = topk.Shard(np.arange(4000), weights)
    j, r, s = shard.search(np.eye(8, dtype=np.int64)[:1], 5, np.array([-1]))
    assert sorted(s.tolist()) == sorted(weights[:, 0])[-5:]


def conversations(spark, convs):
    return spark.createDataFrame([(c, t, r, x) for c, turns in convs for t, r, x in turns], "conv_id long, turn long, role string, text string")


def test_chat_collapse(spark):
    a, b, c = (0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")
    df = conversations(spark, [(5, [a, b]), (2, [a, b, c]), (9, [a, b, c]), (3, [a]), (4, [(0, "user", "other"), b]), (6, [(0, None, None)]), (None, [a, (1, "user", "hello")]), (8, [(None, "user", "z"), (900, "user", "y")])])
    rows = sorted((tuple(r) for r in chat.render(df.withColumn("place", F.lit(0))).collect()), key=str)
    assert {r[0] for r in rows} == {2, 4, 6, 8, None}
    text = {r["conv_id"]: r["rendered"] for r in chat.transcripts(df).collect()}
    assert text[2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert text[6] == "<|im_start|>unknown\n<|im_end|>\n"
    assert text[8].index("y<") < text[8].index("z<")
    assert chat.render(df.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    turns = [(t, "user", str(t % 7)) for t in range(1000)]
    rows = chat.render(conversations(spark, [(1, turns), (2, turns[:700]), (3, turns[:255] + [(255, "user", "x")])])).collect()
    assert sorted({(r["conv_id"], r["n_turns"]) for r in rows}) == [(1, 1000), (3, 256)]
    assert sorted(r["place"] for r in rows if r["conv_id"] == 1) == list(range(1, 1001))


def test_subset_sums():
    rng = random.Random(4)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 80)
        taken = mixing.nearest_subset(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        sums = [sum(n * k for n, k in zip(lengths, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts))]
        got = sum(n * k for n, k in zip(lengths, taken, strict=True))
        assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_large_budgets():
    rng = random.Random(9)
    for lengths, counts, target in (
        (list(range(1, 900)), [rng.randint(1, 40) for _ in range(899)], 1_000_000.0),
        ([7, 1000, 20_000], [5000, 900, 60], 1_234_567.0),
        ([400_000, 9], [12, 2], 3_000_000.0),
    ):
        whole, extra = mixing.fit(lengths, counts, target)
        size = sum(n * k for n, k in zip(lengths, counts, strict=True))
        got = whole * size + sum(n * k for n, k in zip(lengths, extra, strict=True))
        assert all(0 <= e <= k for e, k in zip(extra, counts, strict=True))
        assert abs(got - min(target, 2 * size)) <= (0.5 if len(lengths) > 100 else max(lengths) / 2)


def test_budgets_beside_long_texts(monkeypatch):
    """One very long text, or lengths with a common divisor, make the programme neither slow nor large."""
    rng = random.Random(3)
    counts = [rng.randint(1, 40) for _ in range(3000)]
    for step, long in ((1, 2_000_000), (7, 0), (7, 2_000_000)):
        lengths, have = [step * n for n in range(1, 3001)] + [long] * bool(long), counts + [1] * bool(long)
        size = sum(n * k for n, k in zip(lengths, have, strict=True))
        tracemalloc.start()
        whole, extra = mixing.fit(lengths, have, 0.7 * size + 0.3)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        got = whole * size + sum(n * k for n, k in zip(lengths, extra, strict=True))
        assert all(0 <= e <= k for e, k in zip(extra, have, strict=True))
        assert abs(got - 0.7 * size - 0.3) <= step / 2 + 0.5 and most < 100e6
    # where the documents that the first try leaves don't meet the budget, it comes as near as with all held back
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), 4)) + [rng.randint(200, 400)]
        have = [rng.randint(1, 3) for _ in lengths]
        size, miss = sum(n * k for n, k in zip(lengths, have, strict=True)), []
        target = float(rng.randint(1, size - 1))
        for bound in (1 << 15, 1):
            monkeypatch.setattr(mixing, "LONG", bound)
            miss.append(abs(target - sum(n * k for n, k in zip(lengths, mixing.fit(lengths, have, target)[1], strict=True))))
        assert miss[1] <= miss[0]


def test_targets():
    t = mixing.targets({"a": 10, "b": 1000, None: 1000})
    assert t["a"] == 20 and abs(sum(t.values()) - 1.5 * 2010) < 1e-6 and all(t[s] <= 2 * n + 1e-9 for s, n in {"b": 1000, None: 1000}.items())
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_mixing_hot_and_odd(spark):
    rng = random.Random(2)
    rows = [(i, "w " * 7, "hot") for i in range(600)] + [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", None])) for i in range(600, 1000)] + [(None, "x y", "a"), (5, "w " * 7, "hot"), (1001, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    first = mixing.allocate(df).collect()
    again = mixing.allocate(df.repartition(7)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(first, key=key) == sorted(again, key=key) and len(first) == len(rows)
    for s in {r["__mix_source"] for r in first}:
        mine = [r for r in first if r["__mix_source"] == s]
        taken = sum(r["__mix_size"] * r["__mix_copies"] for r in mine)
        assert abs(taken - mine[0]["__mix_target"]) <= 7 and sum(r["__mix_size"] for r in mine) == mine[0]["__mix_source_size"]
        assert all(0 <= r["__mix_copies"] <= 2 for r in mine)
    assert mixing.allocate(df.limit(0)).count() == 0


def shingles(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-5, None), (-4, ""), (-3, "One Two"), (None, "null id"), (10**12, "last " * 9), (10**12, "a tie")], "doc_id long, text string")
    df = docs.union(odd)
    for parts in (1, 5):
        rows = minhash.edited(df.withColumn("part", F.lit(1)).repartition(3), parts).collect()
        texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
        got = {(r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]): r for r in rows}
        assert len(rows) == len(texts)
        for i, (known, k, t) in enumerate(texts):
            after = texts[(i + 1) % len(texts)]
            if known and k == 10**12:  # tied ids: the first text of the next id follows both
                continue
            q = len(t) // 4
            changed = t[: len(t) - q] + after[2][:q]
            r = got[(known, k, len(t), hashlib.sha256(changed.encode()).hexdigest())]
            assert abs(r["near_edited"] - jaccard(shingles(t, 5), shingles(changed, 5))) < 0.25
            assert abs(r["near_next"] - jaccard(shingles(t, 5), shingles(after[2], 5))) < 0.25
            assert len(r["fingerprint"]) == 512


def test_fingerprints_alone(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    r = minhash.edited(one).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 15
    assert r["edited_sha256"] == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert minhash.edited(one.limit(0)).count() == 0
