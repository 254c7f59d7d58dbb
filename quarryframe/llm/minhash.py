"""Document fingerprints (operator 1): MinHash over five-word shingles.

Universal hash permutations a * x + b modulo 2^64 (a odd) of the shingles' 64-bit hashes, in numpy; a
fingerprint slot keeps 16 mixed bits of the least value.  The likeness of two fingerprints is their share
of equal slots, an estimate of the Jaccard similarity.  `near_duplicates` joins bands of the signatures
in Spark and verifies the pairs that meet by their exact Jaccard similarity; the query gives the class that
these links lead to as near_id, the smallest doc_id in it.

Cases.  Null text: as empty.  Empty texts have a fingerprint of their own, like only itself.  A text of
one to four words has its word sequence as its one shingle.  Texts are read whole.  In `edited`,
documents are ordered by doc_id, nulls first, then text; of repeated ids the first text follows the
document before; a document alone follows itself.  An empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType

from quarryframe.llm import common, ngram_join, textops

SLOTS, WORDS, SEED = 128, 5, 17
#: Slots of a band: texts of similarity 0.8 share one of the 32 bands with a probability of 0.9999999.
BAND = 4
#: Bytes of text that one step handles: its hashes stay in the processor's cache.
STEP = 1 << 17
THRESHOLD = Fraction(4, 5)

_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, SLOTS, dtype=np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """The least value of every permutation (columns) over the shingles of every text (rows)."""
    out = [np.zeros((0, SLOTS), np.uint64)]
    for part in common.chunks(texts, STEP):
        data, offs = common.raw(part)
        low = textops.LOWER[data]
        starts, ends, owner = textops.word_bounds(low, offs)
        hashes, owners = textops.shingles(textops.span_hashes(low, starts, ends), owner, len(part), words)
        least = np.full((len(part), SLOTS), _EMPTY)
        if len(hashes):
            first = np.flatnonzero(np.diff(owners, prepend=-1))
            for slot in range(SLOTS):
                least[owners[first], slot] = np.minimum.reduceat(hashes * _A[slot] + _B[slot], first)
        out.append(least)
    return np.concatenate(out)


def fingerprints(least: np.ndarray) -> np.ndarray:
    """16 bits a slot; empty texts have all bits set."""
    bits = (textops.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    bits[(least == _EMPTY).all(axis=1)] = 0xFFFF
    return bits


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row; an empty text's is 1 with another's and 0 with any other text's."""
    same = (a == b).mean(axis=1)
    empty_a, empty_b = (a == 0xFFFF).all(axis=1), (b == 0xFFFF).all(axis=1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), same)


def _bytes(bits: np.ndarray) -> pa.Array:
    return pa.array([row.astype(">u2").tobytes() for row in bits], pa.binary())


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_neighbours(docs: DataFrame, parts: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(part, peek, doc_id, text) and the kept columns, dealt by ranges of doc_id and sorted; each part ends with a copy of the next one's first row.

    The ranges' bounds are ids that occur, so the first rows are known without a look at the parts.
    """
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)], 10_000).alias("bounds"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = np.array(sorted({found["least"], *(found["bounds"] or [])} - {None}) or [0], np.int64)
    n, nulls = len(bounds), bool(found["nulls"])

    @F.arrow_udf(ArrayType(IntegerType()))
    def places(ids: pa.Array) -> pa.Array:
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        at = pc.fill_null(ids, int(bounds[0])).to_numpy()
        part = np.searchsorted(bounds, at, "right") - 1
        # the first row of a part is also the last look of the part before; places are doubled, odd: a look
        is_first = np.where(part == 0, null if nulls else at == bounds[0], at == bounds[part])
        to = [[2 * p, 2 * ((p - 1) % n) + 1] if f else [2 * p] for p, f in zip(part.tolist(), is_first.tolist(), strict=True)]
        return pa.array(to, pa.list_(pa.int32()))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    dealt = plain.select(F.explode(places("doc_id")).alias("place"), "doc_id", "text", *keep).select(F.expr("cast(place div 2 as int)").alias("part"), (F.col("place") % 2 == 1).alias("peek"), "doc_id", "text", *keep)
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "peek", F.col("doc_id").asc_nulls_first(), "text")


def edited(docs: DataFrame, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) and the kept columns."""
    return _in_hex(_in_bytes(docs, parts, keep))


def _in_hex(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.lower(F.hex(c)).alias(c) if kind == "binary" else c for c, kind in rows.dtypes))


def _in_bytes(docs: DataFrame, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """edited(), with hashes and fingerprints as bytes, half as long."""
    parts = parts or common.partitions(docs.sparkSession)
    kinds = [to_arrow_type(docs.schema[k].dataType) for k in keep]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(ids: list, texts: list[str], bits: np.ndarray, kept: list[list]) -> pa.RecordBatch:
        """Rows for all but the last text, which follows the one before it."""
        changed = [_edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        other = fingerprints(signatures(pa.array(changed, pa.large_string())))
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
            _bytes(bits[:-1]),
            _bytes(other),
            pa.array(likeness(bits[:-1], other)),
            pa.array(likeness(bits[:-1], bits[1:])),
            *(pa.array(x[:-1], kind) for x, kind in zip(kept, kinds, strict=True)),
        ], [*names, *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        kept: list[list] = [[] for _ in keep]
        bits = np.zeros((0, SLOTS), np.uint16)
        over = False
        for batch in batches:
            at = 0
            for part in common.chunks(common.as_texts(batch.column("text"))):
                rows = batch.slice(at, len(part))
                at += len(part)
                looks = rows.column("peek").to_pylist()
                if over:
                    break
                count = looks.index(True) + 1 if True in looks else len(looks)
                over = count < len(looks) or looks[count - 1]
                ids += rows.column("doc_id").to_pylist()[:count]
                texts += part.to_pylist()[:count]
                for column, values in zip(keep, kept, strict=True):
                    values += rows.column(column).to_pylist()[:count]
                bits = np.concatenate([bits, fingerprints(signatures(part.slice(0, count)))])
                if len(texts) > 1:
                    yield emit(ids, texts, bits, kept)
                    ids, texts, bits, kept = ids[-1:], texts[-1:], bits[-1:], [x[-1:] for x in kept]

    schema = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    types = dict(docs.dtypes)
    schema += "".join(f", `{k}` {types[k]}" for k in keep)
    return with_neighbours(docs, parts, keep).select("peek", "doc_id", "text", *keep).mapInArrow(run, schema)


class Bands:
    """Names the cells of a set: its signature's bands."""

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        least = np.full(SLOTS, _EMPTY)
        for at in range(0, len(tokens), 4096):
            some = tokens[at : at + 4096]
            least = np.minimum(least, (some[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
        bands = textops.mix(least).reshape(-1, BAND)
        place = np.arange(len(bands), dtype=np.uint64)
        total = textops.mix(place + np.uint64(1))
        for k in range(BAND):
            total = textops.mix(total ^ bands[:, k])
        return total.view(np.int64)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of texts that links lead to.

    Texts that share a band of their signatures meet in a Spark join, and their exact Jaccard similarity
    decides; a text of a band's crowd is first compared with few others, and no pair within a class twice.
    """
    return ngram_join.connected(docs, ngram_join.sets_of(docs, words, Bands()), words, threshold)


def with_classes(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, parts: int | None = None) -> DataFrame:
    """edited(), with near_id, the class of near_duplicates(); both are joined by id and text hash, so texts move once."""
    found = ngram_join.classes(docs, ngram_join.sets_of(docs, words, Bands()), words, threshold)
    known = common.materialise(found.groupBy("doc_id", "text_key").agg(F.min("component_id").alias("near_id"))).toDF("c_id", "c_key", "near_id")
    plain = docs.select("doc_id", "text", ngram_join.text_key().alias("text_key"))
    rows = _in_bytes(plain, parts, keep=("text_key",))
    return _in_hex(rows.join(known, rows["doc_id"].eqNullSafe(known["c_id"]) & (rows["text_key"] == known["c_key"])).drop("text_key", "c_id", "c_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(common.table(spark, sf_dir, "documents"))
