"""Toxicity (operator 3): nearest labelled examples by exact TF-IDF cosine.

Terms are bare lower-case words; all terms of a bounded sample of labelled texts have a weight, near
copies counting once, and document frequencies come from every document.  A term's inverse document
frequency is multiplied by how strongly the examples tie it to either label, which is never 0; how far that
counts, from hardly to not at all, is chosen by the error on training rows that are no examples.  Every
example of either label stands in a block-max inverted index: like examples share blocks, and a text is
compared with the blocks whose bound reaches its k-th similarity, so the neighbours are exact.  Their votes, weighted by squared
similarity, are calibrated by isotonic regression on labelled rows that are no examples; the nearest
examples are the evidence.

Cases.  Null text: as empty.  A text without sampled terms has no neighbours and gets the calibrated
share of label 1 among such rows.  Without labels, or with one class only, every score is the share of
label 1 (0 without any).  Texts are read whole; equal texts get equal scores; equal similarities go to the
example of smaller index.  Repeated rows and ids give repeated results; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import common, minhash, quality, textops

#: Bounds on labelled rows (half of each label; a quarter calibrates) and on the bytes of their texts, which the driver holds.
SAMPLE, SAMPLE_BYTES = 6_000, 1 << 26
NEIGHBOURS, SEED = 16, 13
#: Least ties to a label that are tried, so that every term weighs; the last, far over any tie, is plain TF-IDF.
FLOORS = (0.01, 0.1, 1.0, 1e6)
#: Share of the examples from which on a term is common; texts and postings that one step of a search handles.
COMMON, TEXTS, POSTINGS = 0.125, 64, 1 << 18
#: Examples of a block; blocks that a search scores first; what rounding may hide.
BLOCK, FIRST, SLACK = 64, 2, 1e-8
#: Directions, and rounds that sharpen them, by which like examples are brought together.
DIRECTIONS, ROUNDS = 16, 3
THRESHOLD = 0.7


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, as often as they stand there, and their text index."""
    low = textops.LOWER[data]
    starts, ends, owner = textops.word_bounds(low, offs, textops.NOT_BARE)
    return textops.span_hashes(low, starts, ends), owner


def _lookup(vocabulary: np.ndarray, hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in the sorted vocabulary, and text index, of the terms that are in it."""
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == hashes
    return at[hit], owners[hit]


class Sparse:
    """Rows of weights: row i has values[cuts[i]:cuts[i + 1]] in the ascending columns cols[...]."""

    def __init__(self, cuts: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int):
        self.cuts, self.cols, self.values, self.width = cuts, cols, values, width

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        rows, cols = np.nonzero(dense)
        return cls(np.searchsorted(rows, np.arange(len(dense) + 1)), cols, dense[rows, cols], dense.shape[1])

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.cuts))

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners(), weights=self.values * vector[self.cols], minlength=len(self))

    def turned(self) -> Sparse:
        order = np.argsort(self.cols, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        return Sparse(cuts, self.owners()[order].astype(np.int32), self.values[order], len(self))

    def take(self, rows: np.ndarray) -> Sparse:
        lengths = np.diff(self.cuts)[rows]
        at = textops.expand(self.cuts[rows], lengths)
        return Sparse(np.concatenate([[0], np.cumsum(lengths)]), self.cols[at], self.values[at], self.width)


class Index:
    """A block-max inverted index of the examples' unit vectors, whose weights are at least 0.

    A term's postings are cut into blocks of BLOCK examples, each with its largest weight; the terms that many
    examples have, whose maxima would bound little, stand in a dense matrix.
    """

    def __init__(self, vectors: Sparse | np.ndarray, labels: np.ndarray, ids: list):
        self.postings = p = (vectors if isinstance(vectors, Sparse) else Sparse.of(vectors)).turned()
        self.labels, self.ids = labels, ids
        common_ = np.diff(p.cuts) > COMMON * p.width
        self.place = np.where(common_, np.cumsum(common_) - 1, -1).astype(np.int32)
        few = p.take(np.flatnonzero(common_))
        self.dense = np.zeros((len(few), p.width))
        self.dense[few.owners(), few.cols] = few.values
        # an entry for each term and block: where its postings begin, and their largest weight
        self.starts = np.arange(0, p.width, BLOCK)
        heads = np.flatnonzero(np.diff(p.owners() * len(self.starts) + p.cols // BLOCK, prepend=-1))
        self.heads = np.append(heads, len(p.cols))
        self.tops = Sparse(np.searchsorted(heads, p.cuts), p.cols[heads] // BLOCK, np.maximum.reduceat(p.values, heads), len(self.starts))

    @property
    def vectors(self) -> Sparse:
        return self.postings.turned()

    def search(self, queries: Sparse, k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the similarities above 0 and indexes of its k nearest examples; equal ones by smaller index.

        What common terms add is known for all examples at once; with the maxima of the other terms it bounds the
        blocks.  The blocks of the largest bounds are scored first, then all whose bound reaches the k-th so far.
        """
        p, tops, n = self.postings, self.tops, self.postings.width
        place = self.place[queries.cols]
        postings, entries = (np.where(place < 0, x.cuts[queries.cols + 1] - x.cuts[queries.cols], 0) for x in (p, tops))
        work = np.concatenate([[0], np.cumsum(postings)])[queries.cuts]
        a = 0
        while a < len(queries):
            b = max(a + 1, min(a + TEXTS, int(np.searchsorted(work, work[a] + POSTINGS, "right")) - 1))
            mine = slice(queries.cuts[a], queries.cuts[b])
            own = np.repeat(np.arange(b - a), np.diff(queries.cuts[a : b + 1]))
            often = place[mine] >= 0
            q = np.zeros((b - a, len(self.dense)))
            q[own[often], place[mine][often]] = queries.values[mine][often]
            entry = textops.expand(tops.cuts[queries.cols[mine]], entries[mine])
            who, weight = np.repeat(own, entries[mine]), np.repeat(queries.values[mine], entries[mine])
            cell = who * tops.width + tops.cols[entry]
            found = q @ self.dense
            bounds = np.maximum.reduceat(found, self.starts, axis=1)
            bounds += np.bincount(cell, weights=weight * tops.values[entry], minlength=bounds.size).reshape(bounds.shape)
            left = bounds > 0
            if tops.width > FIRST:
                now = left & (bounds >= np.partition(bounds, tops.width - FIRST, axis=1)[:, [tops.width - FIRST]])
                self._add(found, now, cell, entry, who, weight)
                left &= ~now
            if n > k:
                left &= bounds >= np.partition(found, n - k, axis=1)[:, [n - k]] - SLACK
            self._add(found, left, cell, entry, who, weight)
            found = np.round(found, 9)
            least = np.partition(found, n - k, axis=1)[:, n - k] if n > k else np.zeros(b - a)
            for row, bound in zip(found, least, strict=True):
                hit = np.flatnonzero((row > 0) & (row >= bound))
                best = hit[np.lexsort((hit, -row[hit]))[:k]]
                yield row[best], best
            a = b

    def _add(self, found: np.ndarray, blocks: np.ndarray, cell: np.ndarray, entry: np.ndarray, who: np.ndarray, weight: np.ndarray) -> None:
        """Adds to found what the entries' postings give in the chosen blocks of each query."""
        p, hit = self.postings, blocks.ravel()[cell]
        at = self.heads[entry[hit]]
        sizes = self.heads[entry[hit] + 1] - at
        rows = textops.expand(at, sizes)
        cells = np.repeat(who[hit] * p.width, sizes) + p.cols[rows]
        found += np.bincount(cells, weights=np.repeat(weight[hit], sizes) * p.values[rows], minlength=found.size).reshape(found.shape)

    def nearest(self, terms_: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """search() for one query."""
        return next(self.search(Sparse(np.array([0, len(terms_)]), terms_, weights, len(self.postings)), k))


def _vectors(vocabulary: np.ndarray, weight: np.ndarray, texts: pa.Array) -> Sparse:
    """Unit vectors of the texts: 1 + log of a term's count, times its weight."""
    at, own = _lookup(vocabulary, *terms(*common.raw(texts)))
    cells, counts = np.unique(own * len(vocabulary) + at, return_counts=True)
    rows, cols = cells // len(vocabulary), cells % len(vocabulary)
    weights = (1 + np.log(counts)) * weight[cols]
    norms = np.sqrt(np.bincount(rows, weights=weights**2, minlength=len(texts)))
    return Sparse(np.searchsorted(rows, np.arange(len(texts) + 1)), cols.astype(np.int32), weights / np.maximum(norms[rows], 1e-12), len(vocabulary))


def gathered(vectors: Sparse) -> np.ndarray:
    """An order of the rows in which like ones stand together: halved along their main directions down to blocks."""
    turned = vectors.turned()
    at = np.random.default_rng(SEED).standard_normal((len(vectors), DIRECTIONS))
    for _ in range(ROUNDS):
        at = np.linalg.qr(np.column_stack([vectors @ (turned @ x) for x in at.T]))[0]
    parts = [np.arange(len(vectors))]
    while len(parts[0]) > BLOCK:
        ways = [at[p, np.argmax(at[p].var(axis=0))] for p in parts]
        parts = [half for p, way in zip(parts, ways, strict=True) for half in np.array_split(p[np.argsort(way, kind="stable")], 2)]
    return np.concatenate(parts)


def vote(index: Index, sims: np.ndarray, rows: np.ndarray) -> tuple[float, list[tuple[object, float]]]:
    """The share of label 1 among the neighbours, by squared similarity (-1: none), and the three nearest."""
    if not len(sims):
        return -1.0, []
    square = sims**2
    return round(float(square @ index.labels[rows] / square.sum()), 9), [(index.ids[r], float(s)) for s, r in zip(sims[:3], rows[:3], strict=True)]


def distinct_rows(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """The first row of each group of near copies of one label, by shared bands of MinHash signatures."""
    bands = textops.mix(minhash.signatures(texts)).reshape(len(texts), -1, minhash.BAND)
    names = textops.mix(np.arange(bands.shape[1], dtype=np.uint64)[None, :] * np.uint64(2) + y.astype(np.uint64)[:, None])
    for k in range(minhash.BAND):
        names = textops.mix(names ^ bands[:, :, k])
    seen: set[int] = set()
    keep = []
    for i, row in enumerate(names.tolist()):
        if seen.isdisjoint(row):
            keep.append(i)
        seen.update(row)
    return np.array(keep, np.int64)


def ties(examples: Sparse, y: np.ndarray) -> np.ndarray:
    """How strongly each term goes with either label: the size of the phi coefficient."""
    n1, n = y.sum(), len(y)
    in1 = np.bincount(examples.cols, weights=y[examples.owners()], minlength=examples.width)
    both = np.bincount(examples.cols, minlength=examples.width)
    apart = np.abs(in1 / n1 - (both - in1) / (n - n1)) * np.sqrt(n1 * (n - n1)) / n
    return apart / np.sqrt(np.maximum(both / n * (1 - both / n), 1e-9))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    # driver-side work on a bounded sample; copies of a text count once
    rows = common.labelled_sample(docs, labels, "toxic", sample, SEED, SAMPLE_BYTES).orderBy("doc_id", "text").toArrow().combine_chunks()
    texts = pc.fill_null(pa.chunked_array(rows["text"].chunks, pa.string()).cast(pa.large_string()).combine_chunks(), "")
    y, ids = rows["y"].to_numpy().astype(float), rows["doc_id"].to_numpy()
    del rows
    if not len(y):
        return {"constant": 0.0}
    at = np.unique(texts.dictionary_encode().indices.to_numpy(), return_index=True)[1]
    at = at[distinct_rows(texts.take(pa.array(at)), y[at])]
    texts, y, ids = texts.take(pa.array(at)), y[at], ids[at]
    if y.min() == y.max():
        return {"constant": float(y[0])}
    if min(y[np.arange(len(y)) % 4 != 3].sum(), (1 - y[np.arange(len(y)) % 4 != 3]).sum()) == 0:
        return {"constant": float(y.mean())}
    known = labels.where(common.fold("doc_id", 3) != 1).groupBy(F.col("toxic").cast("int").alias("y")).count().where("y in (0, 1)").collect()
    rate = {r["y"]: r["count"] for r in known}
    prior = rate.get(1, 0) / max(1, sum(rate.values()))
    calibrates = np.arange(len(y)) % 4 == 3
    vocabulary = np.unique(np.concatenate([np.unique(terms(*common.raw(part))[0]) for part in common.chunks(texts)]))
    if not len(vocabulary):
        return {"constant": prior}

    def count(batches):
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in common.chunks(common.as_texts(batch.column("text"))):
                col, own = _lookup(vocabulary, *terms(*common.raw(part)))
                total += np.bincount(np.unique(own * len(vocabulary) + col) % len(vocabulary), minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(total[seen], n), pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]
    idf = np.log(1 + sums.get(-1, 0) / np.maximum(1, sums.reindex(range(len(vocabulary)), fill_value=0).to_numpy()))
    parts = [_vectors(vocabulary, idf, part) for part in common.chunks(texts)]
    vectors = Sparse(np.concatenate([[0], np.cumsum(np.concatenate([np.diff(v.cuts) for v in parts]))]), np.concatenate([v.cols for v in parts]), np.concatenate([v.values for v in parts]), len(vocabulary))
    del parts, texts
    examples = np.flatnonzero(~calibrates)
    examples = examples[gathered(vectors.take(examples))]
    tie = ties(vectors.take(examples), y[examples])
    truth = y[calibrates]
    weight = np.maximum(np.where(truth == 1, prior / max(truth.sum(), 1), (1 - prior) / max((1 - truth).sum(), 1)) * len(truth), 1e-9)
    ids = ids[examples].tolist()
    best: tuple[float, dict] | None = None
    for floor in FLOORS:
        tied = (floor + tie) / (floor + 1)
        values = vectors.values * tied[vectors.cols]
        values /= np.sqrt(np.bincount(vectors.owners(), weights=values**2, minlength=len(vectors)))[vectors.owners()]
        scaled = Sparse(vectors.cuts, vectors.cols, values, vectors.width)
        index = Index(scaled.take(examples), y[examples], ids)
        votes = np.array([vote(index, *near)[0] for near in index.search(scaled.take(np.flatnonzero(calibrates)))])
        error = crossed_error(votes, truth, weight)
        if best is None or error < best[0]:
            best = error, {"vocabulary": vocabulary, "weight": idf * tied, "index": index, "knots": quality.isotonic(votes, truth, weight)}
    return best[1]


def crossed_error(votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """Weighted squared error of calibrated votes, each half calibrated by the other."""
    half = np.arange(len(votes)) % 2 == 0
    total = 0.0
    for fit in (half, ~half):
        if fit.any() and not fit.all():
            guess = np.interp(votes[~fit], *quality.isotonic(votes[fit], truth[fit], weight[fit]))
            total += float((weight[~fit] * (guess - truth[~fit]) ** 2).sum())
    return round(total, 9)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, evidence): evidence is the three nearest examples, id:similarity, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms of at most SAMPLE texts

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, scores, proof = shared.value, [], []
        if "constant" in m:
            scores, proof = [m["constant"]] * batch.num_rows, [""] * batch.num_rows
        else:
            known: dict[bytes, tuple[float, str]] = {}
            for part in common.chunks(common.as_texts(batch.column("text"))):
                v = _vectors(m["vocabulary"], m["weight"], part)
                keys = [hashlib.blake2b(v.cols[a:b].tobytes() + v.values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(v.cuts[:-1], v.cuts[1:], strict=True)]
                new = {key: i for i, key in enumerate(keys) if key not in known}
                for key, near in zip(new, m["index"].search(v.take(np.array([*new.values()], np.int64))), strict=True):
                    share, best = vote(m["index"], *near)
                    known[key] = (float(np.clip(np.interp(share, *m["knots"]), 0, 1)), ",".join(f"{i}:{s:.4f}" for i, s in best))
                scores += [known[key][0] for key in keys]
                proof += [known[key][1] for key in keys]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(proof, pa.string())], ["doc_id", "score", "evidence"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, score double, evidence string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(common.fold("doc_id", 3) == 1, F.lit(True))
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
