"""Byte-level BPE encoding and decoding (operator 2).

The `tokenizers` library encodes; Spark hands it Arrow batches.  A text is first cut before every
single space that stands between two other characters: the pattern always ends a match there, so the
cuts change no id, and each distinct piece is encoded once per worker.  A byte-level vocabulary names
bytes by printable characters; decoding reverses that table, and a token's offsets in characters come
from counting UTF-8 lead bytes, so a token that starts or ends inside a character covers all of it.

Cases.  Null text: as empty; empty text: no ids, and decoding gives no bytes.  Very long texts are
encoded whole.  Repeated rows and ids give repeated results; other columns don't matter.  An empty
table gives an empty result.  The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import common, textops

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces that a worker keeps; beyond, it starts anew.
KEPT_PIECES = 400_000

#: White space but the space.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_CUT = re.compile(r"(?<=\S) (?=\S)")
_codecs: dict[str, Codec] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class Codec:
    """Encoder and decoder for a rank file's content."""

    def __init__(self, content: bytes, pattern: str = public_tokenizers.PATTERN):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        # Spark runs a worker a core; the library's own threads would only contend with them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(content)
        names = byte_characters()
        name = {token: "".join(names[b] for b in token) for token in ranks}
        # any two neighbours whose joined bytes are a token may merge, at that token's rank
        merges = [
            (name[token[:i]], name[token[i:]])
            for token, rank in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if ranks.get(token[:i], rank) < rank and ranks.get(token[i:], rank) < rank
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # the reverse table, from the vocabulary's names back to bytes
        byte_of = {c: b for b, c in enumerate(names)}
        vocabulary = self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, rank in vocabulary.items():
            tokens[rank] = bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.piece_starts, self.piece_lengths, self.piece_ids = (np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32))
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(lengths.sum()))
        at, end = len(self.index), len(self.index) + len(pieces)
        while end > len(self.piece_starts):
            self.piece_starts, self.piece_lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.piece_starts, self.piece_lengths))
        while self.used + len(flat) > len(self.piece_ids):
            self.piece_ids = np.concatenate([self.piece_ids, np.zeros_like(self.piece_ids)])
        self.piece_lengths[at:end] = lengths
        self.piece_starts[at:end] = self.used + np.cumsum(lengths) - lengths
        self.piece_ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(pieces, range(at, end), strict=True))

    @staticmethod
    def pieces(text: str) -> list[str]:
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHER_SPACE):
            cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
            return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        first, *rest = text.split(" ")
        return [first, *(" " + w for w in rest)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        each = [self.pieces(t) for t in texts]
        flat = list(itertools.chain.from_iterable(each))
        every = dict.fromkeys(flat)
        new = [p for p in every if p not in self.index]
        if len(self.index) + len(new) > KEPT_PIECES:
            self._forget()
            new = list(every)
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        lengths = self.piece_lengths[rows]
        ids = self.piece_ids[textops.expand(self.piece_starts[rows], lengths)]
        totals = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
        return ids, np.diff(totals[np.concatenate([[0], stops])])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and each id's number of bytes.  Unknown ids raise."""
        lengths = self.lengths[ids]
        return self.bytes[textops.expand(self.starts[ids], lengths)], lengths


def character_offsets(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character, end (exclusive) and whether it starts or ends inside a character, for each token of one text."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])  # characters begun before each byte
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inner_start = np.append(~lead, False)[starts]
    inner_end = np.append(~lead, False)[ends]
    return before[starts] - inner_start, before[ends], inner_start | inner_end


def codec(content: bytes) -> Codec:
    """The worker's codec for this rank file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content)
    return _codecs[key]


def _content(path: str | None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): token ids with character offsets."""
    content = docs.sparkSession.sparkContext.broadcast(_content(path))  # a vocabulary file, below 1 MB

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = codec(content.value), []
        for texts in common.chunks(common.as_texts(batch.column("text"))):
            ids, counts = c.encode(texts.to_pylist())
            data, lengths = c.decode(ids)
            stops, byte_stops = np.cumsum(counts), np.concatenate([[0], np.cumsum(lengths)])
            for stop, n in zip(stops, counts, strict=True):
                a, b = byte_stops[stop - n], byte_stops[stop]
                first, last, _ = character_offsets(data[a:b], lengths[stop - n : stop])
                rows.append((ids[stop - n : stop].astype(np.int32), first.astype(np.int32), last.astype(np.int32)))
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), kind) for x in zip(*rows, strict=True))], ["doc_id", "ids", "starts", "ends"])

    return common.map_arrow(docs.select("doc_id", "text"), one, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, data binary, text string): the bytes of the ids, and their text with U+FFFD for what is no UTF-8.

    Null ids give no bytes; an id outside the vocabulary raises.
    """
    content = encoded.sparkSession.sparkContext.broadcast(_content(path))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(content.value)
        data = [c.decode(np.array(ids or [], np.int64))[0].tobytes() for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], ["doc_id", "data", "text"])

    return common.map_arrow(encoded.select("doc_id", "ids"), one, "doc_id long, data binary, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split): encodes, decodes, and returns digests.

    n_split: tokens that start or end inside a character.
    """
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = codec(content.value), []
        for texts in common.chunks(common.as_texts(batch.column("text"))):
            ids, counts = c.encode(texts.to_pylist())
            data, lengths = c.decode(ids)
            little = ids.astype("<u4")
            byte_stops = np.concatenate([[0], np.cumsum(lengths)])
            inner = np.append((data & 0xC0) == 0x80, False)
            split = np.concatenate([[0], np.cumsum(inner[byte_stops[:-1]] | inner[byte_stops[1:]])])
            stops = np.cumsum(counts)
            for stop, n in zip(stops, counts, strict=True):
                rows.append((
                    int(n),
                    hashlib.sha256(little[stop - n : stop].tobytes()).hexdigest(),
                    hashlib.sha256(data[byte_stops[stop - n] : byte_stops[stop]].tobytes()).hexdigest(),
                    int(split[stop] - split[stop - n]),
                ))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")


def token_ids(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns with n_tokens, ids array<int> and exact: whether decoding gives the text back."""
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, counted, every, exact = codec(content.value), [], [], []
        for texts in common.chunks(common.as_texts(batch.column("text"))):
            ids, counts = c.encode(texts.to_pylist())
            data, lengths = c.decode(ids)
            raw, offs = common.raw(texts)
            stops = np.concatenate([[0], np.cumsum(counts)])
            whole = len(data) == len(raw) and bool((data == raw).all())
            byte_stops = np.concatenate([[0], np.cumsum(lengths)])[stops]
            exact += [whole or data[a:b].tobytes() == raw[x:y].tobytes() for a, b, x, y in zip(byte_stops[:-1], byte_stops[1:], offs[:-1], offs[1:], strict=True)]
            counted.append(counts)
            every.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.concatenate(counted), pa.int64()), pa.concat_arrays(every), pa.array(exact, pa.bool_())], [*keep, "n_tokens", "ids", "exact"])

    kinds = dict(docs.dtypes)
    return common.map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), one, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_tokens long, ids array<int>, exact boolean"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
