"""Language identification (operator 7): multinomial naive Bayes over hashed character n-grams.

Counts come from every training document; the matrix of log-probabilities (languages x buckets) is
broadcast in blocks of LANGUAGES, its size fixed by the number of languages and BUCKETS (128 KB a language);
batches are scored in numpy, block by block.

Cases.  Text null or without a letter: `und`, score 0.  No labelled document at all: `und` everywhere.
Null lang, null text and null ids are never learned from; an empty lang is a language like any other.  Texts are read whole.  Equal posteriors go to
the language first by code point.  Repeated rows and ids give repeated results; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import common

BUCKETS = 1 << 14
SIZES = (2, 3)
#: Languages of a block of the matrix, and languages whose counts a task holds at once.
LANGUAGES = 128

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letter


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, how many each text has, and whether each text has a letter.

    Lower case; runs of other characters than letters count as one space.
    """
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    is_letter = letters()[points]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (owner[1:] == owner[:-1])  # a letter, or the first of what follows one
    c = np.where(is_letter, points, np.uint32(32))[keep]
    owner = owner[keep]
    buckets, owners = [], []
    for n in SIZES:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            whole = owner[: len(c) - n + 1] == owner[n - 1 :]
            buckets.append((h[whole] & np.uint32(BUCKETS - 1)).astype(np.int64))
            owners.append(owner[: len(c) - n + 1][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.bincount(owner, minlength=len(texts)) > 0
    flat, own = np.concatenate(buckets), np.concatenate(owners)
    return flat, own, np.bincount(owner, minlength=len(texts)) > 0


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and log-probabilities (languages x BUCKETS) from (text, lang) of all rows."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    priors = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(priors)
    if not langs:
        return [], np.zeros(0), np.zeros((0, BUCKETS))

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            cells = {lang: np.flatnonzero(total) for lang, total in held.items()}
            names = pa.array([lang for lang, at in cells.items() for _ in range(len(at))], pa.string())
            at, n = ([np.zeros(0, np.int64), *x] for x in (cells.values(), (held[lang][at] for lang, at in cells.items())))
            held.clear()
            return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(at)), pa.array(np.concatenate(n))], ["lang", "bucket", "n"])

        for batch in batches:
            texts = common.as_texts(batch.column("text"))
            which, at = batch.column("lang").to_pylist(), 0
            for part in common.chunks(texts):
                here = which[at : at + len(part)]
                at += len(part)
                names = sorted(set(here))
                place = {lang: i for i, lang in enumerate(names)}
                flat, own, _ = ngrams(part.to_pylist())
                row = np.array([place[x] for x in here], np.int64)
                # the counts of a few languages at a time: a part may name as many as it has texts
                for low in range(0, len(names), LANGUAGES):
                    some = names[low : low + LANGUAGES]
                    mine = (row[own] >= low) & (row[own] < low + len(some))
                    total = np.bincount((row[own[mine]] - low) * BUCKETS + flat[mine], minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
                    if len(held.keys() | set(some)) > LANGUAGES:
                        yield given()
                    for lang, counts in zip(some, total, strict=True):
                        held[lang] = held[lang] + counts if lang in held else counts
        yield given()

    place = {lang: i for i, lang in enumerate(langs)}
    logs = np.full((len(langs), BUCKETS), -np.log(BUCKETS))  # of languages without any n-gram
    sums = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    each = sums.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).toArrow()  # at most BUCKETS numbers a language
    for lang, at, n in zip(*(each[c].combine_chunks() for c in ("lang", "at", "n")), strict=True):
        found = np.ones(BUCKETS)
        found[at.values.to_numpy()] += n.values.to_numpy()
        logs[place[lang.as_py()]] = np.log(found / found.sum())
    n = np.array([priors[x] for x in langs], float)
    return langs, np.log(n / n.sum()), logs


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score, the posterior of the predicted language."""
    langs_, prior_, logs_ = model
    context = docs.sparkSession.sparkContext
    names_ = context.broadcast((langs_, prior_))
    shared = [context.broadcast(logs_[i : i + LANGUAGES]) for i in range(0, len(langs_), LANGUAGES)]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, prior = names_.value
        logs = [row for block in shared for row in block.value]
        names, scores = [], []
        for part in common.chunks(common.as_texts(batch.column("text"))):
            flat, own, has = ngrams(part.to_pylist())
            if not langs:
                has[:] = False
            sums = np.stack([np.bincount(own, weights=row[flat], minlength=len(part)) + p for row, p in zip(logs, prior, strict=True)]) if langs else np.zeros((1, len(part)))
            best = sums.argmax(axis=0)
            score = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
            names += [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
            scores += np.where(has, score, 0.0).tolist()
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return common.map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), one, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["lang_pred string", "score double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(common.fold("doc_id", 5) == 0, F.lit(True))
    model = train(docs.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
