"""Quality classifier (operator 9).

Document statistics, standardised, go through random Fourier features, which approximate a Gaussian
kernel; ridge regression on them is fitted from normal equations summed over partitions; isotonic
regression on a part of the sample that the ridge never saw turns its value into a score.  Each class
weighs as much as it does among all usable labels, so a score means the same at every input size.

Cases.  Null text: as empty; empty texts get the score that the model gives to all-zero counts.  Without
labels, or with one class only, every score is the share of label 1 (0.5 without any).  Texts are read
whole.  Equal texts get equal scores.  Repeated rows and ids give repeated results; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import common, textops

#: Bound on the labelled rows that the model is fitted on; a quarter of them calibrates.
SAMPLE = 12_000
FEATURES, RIDGE, SEED = 256, 1.0, 7
THRESHOLD = 0.5

#: Byte classes: other, space, newline, lower, upper, digit, sentence mark, bar, exclamation, other symbol, lead byte, trail byte.
_CLASS = np.zeros(256, np.int64)
_CLASS[[32, 9, 11, 12, 13]] = 1
_CLASS[10] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[ord("|")] = 7
_CLASS[ord("!")] = 8
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 9
_CLASS[192:] = 10
_CLASS[128:192] = 11
_CLASSES = 12
N_STATS = 20


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of N_STATS figures for every text."""
    count = len(offs) - 1
    owner = np.repeat(np.arange(count), np.diff(offs))
    hist = np.bincount(owner * _CLASSES + _CLASS[data], minlength=count * _CLASSES).reshape(count, _CLASSES).astype(float)
    chars = hist.sum(axis=1) - hist[:, 11]
    letters = hist[:, 3] + hist[:, 4] + hist[:, 10]
    low = textops.LOWER[data]
    starts, ends, of = textops.word_bounds(low, offs)
    lengths = ends - starts
    words = np.bincount(of, minlength=count).astype(float)
    hashes = textops.span_hashes(low, starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=count)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(count)
    np.maximum.at(top, o[new], runs)
    first, last = data[starts], data[ends - 1]
    per_char = lambda x: x / np.maximum(chars, 1)
    per_word = lambda x: x / np.maximum(words, 1)
    number = lambda mask: np.bincount(of[mask], minlength=count)
    mean_length = per_word(np.bincount(of, weights=lengths, minlength=count))
    return np.stack([
        np.log1p(words),
        mean_length,
        np.sqrt(np.maximum(per_word(np.bincount(of, weights=lengths.astype(float) ** 2, minlength=count)) - mean_length**2, 0)),
        hist[:, 4] / np.maximum(letters, 1),
        per_char(hist[:, 5]),
        per_char(hist[:, 6]),
        per_char(hist[:, 7]),
        per_char(hist[:, 8]),
        per_char(hist[:, 9]),
        per_char(hist[:, 10]),
        per_char(hist[:, 1]),
        per_char(hist[:, 2]),
        per_char(letters),
        per_word(distinct) * np.log1p(words),
        per_word(top),
        per_word(number(again)),
        per_word(number(_CLASS[last] == 6)),
        per_word(number(_CLASS[last] >= 7) - number(_CLASS[last] >= 10)),
        per_word(number(_CLASS[first] == 4)),
        per_word(number(lengths == 1)),
    ], axis=1)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([statistics(*common.raw(part)) for part in common.chunks(common.as_texts(batch.column("text")))])


def _waves(stats: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS)
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - center) / scale, -6, 6)
    return np.concatenate([np.cos(z @ w + shift) * np.sqrt(2 / FEATURES), np.ones((len(stats), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y to x, weighted by w (pool adjacent violators)."""
    w = np.ones(len(x)) if w is None else w
    values, place = np.unique(x, return_inverse=True)
    weights = np.bincount(place, weights=w)
    means = np.bincount(place, weights=y * w) / weights
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for v, w, m in zip(values, weights, means, strict=True):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = [k for m, _, a, b in blocks for k in ((a, m), (b, m))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def train(sample: DataFrame) -> dict:
    """The model from labelled rows (doc_id, text, y, w), a bounded sample; w weights a row."""

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _stats_of(batch)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "y", "w")), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "y", "w", "stats"])

    rows = common.materialise(common.map_arrow(sample, stats, "doc_id long, y int, w double, stats array<double>").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4))))
    share = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("w1")).first()
    if not share["n"]:
        return {"constant": 0.5}
    if share["ones"] in (0, share["n"]):
        return {"constant": share["ones"] / share["n"]}
    unit = share["n"] / share["w"]  # weights of mean 1, so that RIDGE weighs the same at every size
    fit, rest = rows.where("part > 0"), rows.where("part = 0")
    classes = fit.groupBy("y").agg(F.sum("w").alias("w"), *(f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("v", F.var_pop)))).orderBy("y").collect()
    if not classes:
        return {"constant": share["w1"] / share["w"]}
    part, mean, var = (np.array([[r[f"{n}{i}"] for i in range(N_STATS)] for r in classes]) if n else np.array([[r["w"]] for r in classes]) for n in ("", "m", "v"))
    center = (part * mean).sum(axis=0) / part.sum()
    scale = np.maximum(np.sqrt((part * (var + (mean - center) ** 2)).sum(axis=0) / part.sum()), 1e-6)

    def equations(batches):
        size = FEATURES + 1
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = _waves(np.stack(batch.column("stats").to_numpy(zero_copy_only=False)), center, scale)
                w = np.asarray(batch.column("w"), float) * unit
                a += x.T @ (x * w[:, None])
                b += x.T @ (w * np.asarray(batch.column("y"), float))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    # the rows are a bounded sample, so a few partitions hold them, and a few sums reach the driver
    a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for r in fit.repartition(4).mapInArrow(equations, "a binary, b binary").collect():
        a += np.frombuffer(r["a"]).reshape(a.shape)
        b += np.frombuffer(r["b"])
    weights = np.linalg.solve(a + RIDGE * np.diag([1.0] * FEATURES + [1e-9]), b)
    model = {"center": center, "scale": scale, "weights": weights}
    left = rest.select("stats", "y", "w").toPandas()
    if len(left):
        x = _waves(np.stack(left["stats"].to_numpy()), center, scale) @ weights
        model["knots"] = isotonic(np.round(x, 6), left["y"].to_numpy(float), left["w"].to_numpy(float))
    else:
        model["knots"] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns with the score, 0 to 1, in a column of the given name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        if "constant" in m:
            out = np.full(batch.num_rows, float(m["constant"]))
        else:
            x = _waves(_stats_of(batch), m["center"], m["scale"]) @ m["weights"]
            out = np.clip(np.interp(np.round(x, 6), *m["knots"]), 0, 1)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.float64())], [*keep, name])

    kinds = dict(docs.dtypes)
    return common.map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), one, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{name}` double"]))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    return train(common.labelled_sample(docs, common.table(spark, sf_dir, "labels"), "quality", SAMPLE, SEED))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(common.fold("doc_id", 3) == 1, F.lit(True))
    return score(docs, fitted(spark, docs, sf_dir)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
