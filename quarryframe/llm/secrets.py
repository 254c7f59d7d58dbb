"""Secret scans (operator 4).

Fixed patterns give the base spans.  Character Markov models of random strings and of ordinary
identifiers, trained from labelled samples and compared by log-likelihood ratio, add spans of kind
`markov` where no base span lies.  Tokens are judged by themselves and as + and / join them, with = at the
end; ordinary lower-case pieces at the ends of such a run are no part of it.

Cases.  Null and empty texts: no spans.  Texts are scanned whole, however long.  Repeated rows and ids
give repeated results; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import common, textops

#: The base patterns; keywords in either case of ASCII.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")

#: Necessary conditions for RE2, which finds the few texts that the patterns above then search.
_MAYBE = (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
_NOT_TOKEN = _CODE < 0
_NOT_JOINED = _NOT_TOKEN.copy()
_NOT_JOINED[[ord("+"), ord("/")]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[97:123] = True
#: Shortest token that the models judge.
SHORTEST = 20
#: Log-likelihood ratio a token needs: in all, and per character pair.
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.6
#: Bound on the documents that give labelled samples, and on samples of each label.
SAMPLE_DOCUMENTS, SAMPLES = 2_000, 20_000


def base_spans(text: str, maybe: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base matches, in order."""
    spans = []
    if maybe[0]:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if maybe[1]:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if maybe[2]:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(spans)


def train(samples: Iterable[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratios of character pairs, random against ordinary, from (string, 1 if random else 0)."""
    counts = np.ones((2, len(_ALPHABET), len(_ALPHABET)))
    for value, label in samples:
        codes = _CODE[np.frombuffer(value.encode(), np.uint8)]
        codes = codes[codes >= 0]
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    chances = counts / counts.sum(axis=2, keepdims=True)
    return np.log(chances[1]) - np.log(chances[0])


def random_strings(n: int, seed: int = 0) -> list[tuple[str, int]]:
    """n labelled samples of random strings over the alphabets that keys use."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _ALPHABET[:62], _ALPHABET)
    return [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 48))), 1) for _ in range(n)]


def identifiers(words: list[str], seed: int = 0) -> list[tuple[str, int]]:
    """Labelled samples of ordinary identifiers: the words themselves, and joined in the usual styles."""
    rng, out = random.Random(seed), []
    for w in words:
        out.append((w, 0))
        pair = [w, rng.choice(words)]
        out.append((rng.choice(("_".join(pair), "-".join(pair), "".join(x.capitalize() for x in pair), "_".join(pair).upper(), f"{'_'.join(pair)}_{rng.randint(0, 99)}")), 0))
    return out


def samples_from(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, bound: int = SAMPLES, seed: int = 0) -> list[tuple[str, int]]:
    """At most `bound` samples of either label, from at most `documents` documents chosen by a hash of the id.

    Values that the base patterns find, and seeded random strings, are labelled random; words outside
    base spans, and identifiers made of them, ordinary.
    """
    ids = docs.select("doc_id").where("doc_id is not null").select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("h")).orderBy("h", "doc_id").limit(documents)
    picked = common.materialise(ids.select(F.col("doc_id").alias("_id")).distinct())
    # of a repeated id the least text, so that the bound holds
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, int], None] = {}
        for text in common.as_texts(batch.column("text")).to_pylist():
            spans, at, rest = base_spans(text), 0, []
            for start, kind, end in spans:
                value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
                found[(value, 1)] = None
                rest.append(text[at:start])
                at = max(at, end)
            rest.append(text[at:])
            found.update(((w, 0), None) for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]{4,}", " ".join(rest)))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32())], ["value", "label"])

    rows = common.map_arrow(texts, one, "value string, label int").distinct()
    order = [F.xxhash64("value", F.lit(seed)), "value"]
    secret = [(r[0], 1) for r in rows.where("label = 1").orderBy(*order).limit(bound // 2).collect()]
    words = [r[0] for r in rows.where("label = 0").orderBy(*order).limit(bound // 2).collect()]
    return secret + random_strings(bound // 2, seed) + identifiers(words, seed)


def markov_spans(data: np.ndarray, offs: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, start and end in bytes of the tokens that look random."""
    runs, stops, texts = textops.word_bounds(data, offs, _NOT_JOINED)
    # padding ends a run where no more of it follows
    padded = stops.copy()
    for _ in range(2):
        more = padded < offs[texts + 1]
        padded[more] += data[padded[more]] == ord("=")
    after = padded < offs[texts + 1]
    after[after] = ~_NOT_JOINED[data[padded[after]]]
    padded[after] = stops[after]
    long = padded - runs >= SHORTEST
    runs, stops, padded = runs[long], stops[long], padded[long]
    starts, ends, owner = textops.word_bounds(data, offs, _NOT_TOKEN)
    if not len(runs):
        return owner[:0], starts[:0], ends[:0]
    run = np.searchsorted(runs, starts, "right") - 1
    inside = (run >= 0) & (ends <= stops[run])
    starts, ends, owner, run = starts[inside], ends[inside], owner[inside], run[inside]
    if not len(starts):
        return owner, starts, ends
    lengths = ends - starts - 1
    at = textops.expand(starts, lengths)
    sums = np.concatenate([[0.0], np.cumsum(ratios[_CODE[data[at]], _CODE[data[at + 1]]])])
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    total = sums[cuts[1:]] - sums[cuts[:-1]]
    alone = (ends - starts >= SHORTEST) & (total >= LEAST_TOTAL) & (total >= LEAST_MEAN * lengths)

    plain = np.concatenate([[0], np.cumsum(_PLAIN[data])])
    kept = np.flatnonzero((total >= 0) | (plain[ends] - plain[starts] < ends - starts))
    _, first, count = np.unique(run[kept], return_index=True, return_counts=True)
    first, last = kept[first], kept[first + count - 1]
    several = last > first
    first, last = first[several], last[several]
    # joiners at an end belong to the token where its first or last piece is the run's
    opens = np.where(np.append(-1, run)[first] == run[first], starts[first], runs[run[first]])
    closes = np.where(np.append(run, -1)[last + 1] == run[last], ends[last], padded[run[last]])
    whole = sums[cuts[last + 1]] - sums[cuts[first]]
    good = (closes - opens >= SHORTEST) & (whole >= LEAST_TOTAL) & (whole >= LEAST_MEAN * (cuts[last + 1] - cuts[first]))
    first, last, opens, closes = first[good], last[good], opens[good], closes[good]
    alone[textops.expand(first, last - first + 1)] = False

    # a single piece takes its padding along
    full = np.where(ends == stops[run], padded[run], ends)
    begins, finishes, texts = (np.concatenate(x) for x in ((opens, starts[alone]), (closes, full[alone]), (owner[first], owner[alone])))
    order = np.argsort(begins)
    begins, finishes, texts = begins[order], finishes[order], texts[order]
    return texts, begins - offs[texts], finishes - offs[texts]


def uncovered(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of the spans found that no base span covers; both in order of start, and read once."""
    out, at, reach = [], 0, []  # reach: base spans that may cover the next span too
    for start, end in found:
        while at < len(base) and base[at][0] < end:
            reach.append(base[at])
            at += 1
        reach = [b for b in reach if b[2] > start]
        for s, _, e in reach:
            if s > start:
                out.append((start, min(s, end)))
            start = max(start, e)
            if start >= end:
                break
        if start < end:
            out.append((start, end))
    return out


def scan_texts(texts: pa.Array, ratios: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For every text its (start, kind index, end), in code points, by start and kind."""
    found: list[list[tuple[int, int, int]]] = []
    for part in common.chunks(texts):
        maybe = [pc.match_substring_regex(part, p).to_pylist() for p in _MAYBE]
        data, offs = common.raw(part)
        extra: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(*(x.tolist() for x in markov_spans(data, offs, ratios)), strict=True):
            extra.setdefault(i, []).append((a, b))
        for i, m in enumerate(zip(*maybe, strict=True)):
            if not any(m) and i not in extra:
                found.append([])
                continue
            text = part[i].as_py()
            spans = base_spans(text, m)
            if i in extra:
                # code points before each byte: tokens are ASCII, so their lengths stay
                before = np.concatenate([[0], np.cumsum((data[offs[i] : offs[i + 1]] & 0xC0) != 0x80)])
                tokens = [(int(before[a]), int(before[a]) + b - a) for a, b in extra[i]]
                spans = sorted(spans + [(a, 3, b) for a, b in uncovered(tokens, spans)])
            found.append(spans)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>), by start and kind; code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 64 x 64 doubles

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in scan_texts(common.as_texts(batch.column("text")), shared.value)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, ratios: np.ndarray, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mask, and n_chars (if there) set anew; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.as_texts(batch.column("text"))
        out = batch.column("text").to_pylist()
        for i, spans in enumerate(scan_texts(texts, shared.value)):
            if spans:
                parts, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        parts += [out[i][at:a], mask]
                    at = max(at, b)
                out[i] = "".join([*parts, out[i][at:]])
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["text"] = pa.array(out, batch.schema.field("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pc.if_else(pc.is_null(columns["text"]), columns["n_chars"], pc.utf8_length(columns["text"]).cast(batch.schema.field("n_chars").type))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return common.map_arrow(docs, one, docs.schema)


def digests(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan_texts(common.as_texts(batch.column("text")), shared.value)
        counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
        base = [hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts[:3], pa.array(base, pa.string()), pa.array([joined(s) for s in found], pa.string()), counts[3]],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
        )

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return digests(docs, train(samples_from(docs)))
