"""N-gram Jaccard join (operator 8): a count-vector R-tree within cells.

A document's tokens are its distinct n-word shingles.  They are hashed into groups; the counts by group
are the document's point, and the summed minima of two points bound the overlap of their sets.  Points
lie in R-trees: a node keeps the coordinate-wise maxima of what is below, so one sum bounds a whole node.

An R-tree over all points would be one task, so the tokens are hashed a second time, into slices, and a
tree is built for each cell, that is for the documents that agree in a slice.  Two sets of similarity t
with sizes up to s differ in at most e = floor(2 s (1 - t) / (1 + t)) tokens; of more than e slices at
least one is then equal, so every link is inside some cell, and none is lost.  The number of slices depends
on a class of sizes; a document near the upper end of its class also goes to the cells of the next.
Empty slices name cells only for documents that have more of them than spare slices.

1. Equal sets are one node.  2. Cells with two nodes or more are kept, and of cells with the same nodes one.
3. Every node is held against the one it meets in most cells (a star, so linear), by the points' bound and,
where that allows a link, exactly; the components of these links are the first labels.  4. In each cell the R-tree finds the pairs of different labels whose bound
allows a link, and names a pair only in the first cell it shares.  While most such pairs still link, only each
node's nearest is verified, which settles most of every group in linearly many pairs; then, with the labels
that follow, all that are left.  Exact intersections verify them.  5. Links become components.  A large cell is
cut into blocks, and its pairs of blocks are separate tasks.

Nodes are known by a 64-bit hash of their sets, tokens by 64-bit hashes; below a hundred million distinct
texts two of either meet by chance with a probability under a thousandth.

Cases.  Null and empty texts, and texts without words: no tokens, linked with nothing, each its own
component.  With fewer words than n, the whole sequence is the one token.  Texts are read whole.
Repeated rows and texts are links of similarity 1.  A row with a null id links like any other and never
names a component unless all its members' ids are null.  Rows of one id with different texts are
documents of their own, which may stand in different components of one name.  An empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import common, textops

#: Least coordinates of a point; children of a tree's node; nodes of a cell block, of which a task pairs two.
GROUPS, FAN, CELL_BLOCK = 64, 16, 4096
#: Coordinates that one step of a tree compares.
STEP = 1 << 20
#: Least keys of a node by which its pairs know their first common cell.
EARLY = 16
#: Share of nearest pairs that must link for another round of them; below, all that is left is verified.
PRODUCTIVE = 0.5
#: Edges of the graph of links that one task holds.
EDGES_A_TASK = 200_000
#: Growth of the size classes.
CLASS_RATIO = 1.5


class Slices:
    """Size classes, and how many slices each has, for a threshold."""

    def __init__(self, threshold: Fraction, longest: int = 1 << 31):
        self.threshold = threshold
        self.lows = [1]
        while self.lows[-1] <= longest:
            self.lows.append(max(int(self.lows[-1] * CLASS_RATIO), math.floor(self.lows[-1] / threshold)) + 1)
        self.counts, self.spare = [], []
        for low, after in zip(self.lows[:-1], self.lows[1:], strict=True):
            differ = math.floor(2 * (after - 1) * (1 - threshold) / (1 + threshold))
            # as many spare slices as a set of the least size leaves empty, about
            empty = (differ + 1) * math.exp(-low / (differ + 1))
            spare = math.ceil(empty + 2 * math.sqrt(empty)) if differ else 0
            self.counts.append(differ + 1 + spare)
            self.spare.append(spare)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The cells of a sorted set of token hashes."""
        size = len(tokens)
        if not size:
            return np.zeros(0, np.int64)
        own = int(np.searchsorted(self.lows, size, "right")) - 1
        classes = [own] + [own + 1] * (math.floor(size / self.threshold) >= self.lows[own + 1])
        out = []
        for c in classes:
            count = self.counts[c]
            slot = ((textops.mix(tokens + np.uint64(0x51CE)) >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            slot = slot.astype(np.int64)
            held = np.bincount(slot, minlength=count)
            order = np.argsort(slot, kind="stable")
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.mix(tokens[order] ^ np.uint64(0xC311)))])
            stops = np.cumsum(held)
            digest = sums[stops] - sums[stops - held]
            name = np.arange(count, dtype=np.uint64) + (np.uint64(c + 1) << np.uint64(40))
            cell = textops.mix(digest + textops.mix(name) + held.astype(np.uint64))
            empty = np.flatnonzero(held == 0)
            dropped = empty[max(0, len(empty) - self.spare[c]) :]
            out.append(np.delete(cell, dropped))
        # 48 bits: the rest would cost shuffle, and a chance meeting only a vain comparison
        return (np.concatenate(out) >> np.uint64(16)).view(np.int64)


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens by group, a byte each; groups are ranges of the hash, so that halving their number adds neighbours.

    A set has a group for every one or two tokens, at least GROUPS, and more where a count would pass a byte.
    """
    bits = max(GROUPS.bit_length() - 1, (len(tokens) // 2).bit_length())
    while True:
        counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        bits += 1


def folded(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Points of different resolution, one after the other in flat, as rows of the coarsest one."""
    least = int(lengths.min())
    # bytes, unless a sum of neighbours can pass them
    out = np.empty((len(starts), least), np.uint8 if lengths.max() == least else np.int32)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        values = flat[textops.expand(starts[rows], lengths[rows])]
        out[rows] = values.reshape(len(rows), least, n // least).sum(axis=2, dtype=np.int32)
    return out


def overlap(points: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Summed minima of points[i] and others[j], pair by pair: what the sets can share at most."""
    step = max(1, STEP // max(1, points.shape[1]))
    return np.concatenate([np.zeros(0, np.int64), *(np.minimum(points[i[k : k + step]], others[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step))])


def node_of(tokens: np.ndarray) -> int:
    """A hash of the set."""
    with np.errstate(over="ignore"):
        return int(textops.mix(np.array([textops.mix(tokens ^ np.uint64(0x0DE)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


class Tree:
    """A packed R-tree of points in order of size and largest group: FAN points a leaf, FAN nodes a node above.

    A node keeps the coordinate-wise maxima of what is below it, and the least and largest size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FAN:
            most, low, high = self.levels[-1]
            cuts = np.arange(0, len(most), FAN)
            self.levels.append((np.maximum.reduceat(most, cuts, axis=0), low[cuts], np.maximum.reduceat(high, cuts)))

    def _spans(self, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and largest of a value of the rows, below every node of every level."""
        out = [(values[self.order], values[self.order])]
        for most, _, _ in self.levels[:-1]:
            cuts = np.arange(0, len(most), FAN)
            out.append((np.minimum.reduceat(out[-1][0], cuts), np.maximum.reduceat(out[-1][1], cuts)))
        return out

    def pairs(self, labels: np.ndarray, threshold: Fraction, halves: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) of different labels whose bound on the overlap allows the threshold; with halves, one of each half."""
        p, q = threshold.numerator, threshold.denominator
        apart = [self._spans(x) for x in ([labels] if halves is None else [labels, halves])]
        top = len(self.levels) - 1
        todo = [(top, *np.triu_indices(len(self.levels[top][0]), int(top == 0)))]
        while todo:
            level, a, b = todo.pop()
            if level and len(a) > 64:  # few nodes at a time have their children compared
                todo.append((level, a[64:], b[64:]))
                a, b = a[:64], b[:64]
            most, low, high = self.levels[level]
            good = low[b] * p <= high[a] * q  # sizes only grow
            for spans in apart:
                least, largest = spans[level]
                good &= (least[a] != largest[b]) | (largest[a] != least[b])
            a, b = a[good], b[good]
            good = overlap(most, most, a, b) * (p + q) >= p * (low[a] + low[b])
            a, b = a[good], b[good]
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b]
                continue
            below = len(self.levels[level - 1][0])
            i, j = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
            x, y = ((z[:, None] * FAN + w).ravel() for z, w in ((a, i), (b, j)))
            inside = (x < below) & (y < below) & (x < y if level == 1 else x <= y)
            todo.append((level - 1, x[inside], y[inside]))


def text_key() -> Column:
    """A hash of the text (null: empty), which with the id names a document."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(docs: DataFrame, n: int, cells: Slices) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, keys, point) of every row; node is null without tokens.  cells.keys names a set's cells.

    In each task the first row of a node has keys and point, later ones none: copies add nothing to the cells.
    """
    schema = "doc_id long, text_key long, n_shingles long, node long, keys array<long>, point binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, texts in common.in_chunks(batches):
            sizes, nodes, keys, points = [], [], [], []
            for tokens in textops.shingle_sets(*common.raw(texts), n):
                node = node_of(tokens) if len(tokens) else None
                new = len(tokens) > 0 and node not in seen
                sizes.append(len(tokens))
                nodes.append(node)
                keys.append(cells.keys(tokens) if new else None)
                points.append(point(tokens).tobytes() if new else None)
                if new:
                    seen.add(node)
            found = [pa.array(x, kind) for x, kind in ((sizes, pa.int64()), (nodes, pa.int64()), (keys, pa.list_(pa.int64())), (points, pa.binary()))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), *found], ["doc_id", "text_key", "n_shingles", "node", "keys", "point"])

    return _documents(docs).mapInArrow(run, schema)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")


def _tokens_of(texts: DataFrame, n: int) -> DataFrame:
    """(node, tokens array<long>) from (node, text): rows whose text is the node's, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, texts in common.in_chunks(batches):
            nodes, tokens = [], []
            for found, node in zip(textops.shingle_sets(*common.raw(texts), n), rows.column("node").to_pylist(), strict=True):
                if node not in seen and len(found) and node_of(found) == node:
                    seen.add(node)
                    nodes.append(node)
                    tokens.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens array<long>")


def _possible(pairs: DataFrame, known: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose points' bound allows the threshold; known is (node, size, point)."""
    p, q = threshold.numerator, threshold.denominator
    ends = [known.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("point").alias(f"point_{x}")) for x in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x for both in zip(batch.column("point_a").to_pylist(), batch.column("point_b").to_pylist(), strict=True) for x in both]
            lengths = np.array([len(x) for x in raw], np.int64)
            starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(raw), np.uint8)
            sizes = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for rows, shared in _overlaps(flat, starts, lengths, 2 * np.arange(batch.num_rows)):
                good[rows // 2] = shared * (p + q) >= p * sizes[rows // 2]
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(good)) for x in ("a", "b")], ["a", "b"])

    return pairs.join(ends[0], "a").join(ends[1], "b").mapInArrow(run, "a long, b long")


def _overlaps(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What point i and point i + 1 share at most, for every i of firsts: some of firsts at a time, and their overlaps.

    A tree of two points is one sum; pairs are taken together by the resolution that both have.
    """
    least = np.minimum(lengths[firsts], lengths[firsts + 1])
    for n in np.unique(least):
        for part in np.array_split(firsts[least == n], max(1, int((least == n).sum() * n // STEP))):
            both = np.stack([part, part + 1], axis=1).ravel()
            points = folded(flat, starts[both], lengths[both])
            yield part, overlap(points, points, np.arange(0, len(both), 2), np.arange(1, len(both), 2))


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold, written; the sets are made anew from one text a node.

    firsts is (node, first_id, text_key), and the pairs are few: what the points' bounds leave.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # written, so that its size is known when the join with the texts is planned: a small one spares their shuffle
    where = common.materialise(firsts.join(asked, "node", "left_semi").select("node", F.col("first_id").alias("a_id"), F.col("text_key").alias("a_key")))
    plain = _documents(docs)
    texts = plain.join(common.small(where, 24), plain["doc_id"].eqNullSafe(where["a_id"]) & (plain["text_key"] == where["a_key"])).select("node", "text")
    tokens = common.materialise(_tokens_of(texts, n))
    both = pairs.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b")
    same = F.size(F.array_intersect("ta", "tb")).cast("long")
    union = F.size("ta") + F.size("tb") - same
    # repeated rows of one id and text give a node's tokens once a task
    found = common.materialise(both.where(same * threshold.denominator >= union * threshold.numerator).select("a", "b").distinct())
    common.drop(tokens, where)
    return found


def _nearest(i: np.ndarray, j: np.ndarray, likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) one for each i and one for each j, the likeliest."""
    keep = np.zeros(len(i), bool)
    for end in (i, j):
        order = np.lexsort((-likeness, end))
        keep[order[np.flatnonzero(np.diff(end[order], prepend=-1))]] = True
    return i[keep], j[keep], likeness[keep]


def first_met(early: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j meet in no cell before this one, as far as the least keys of both tell.

    early has each row's least keys in a row of its own, filled up with the largest number.  A common key
    that both lists hold is the least of all, so a pair is named in one cell, or, where the lists hold none, in each.
    """
    none = np.iinfo(np.int64).max
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        here = slice(k, k + (1 << 14))
        both = np.sort(np.concatenate([early[i[here]], early[j[here]]], axis=1), axis=1)
        least = np.where(both[:, 1:] == both[:, :-1], both[:, 1:], none).min(axis=1)
        out[here] = (least == none) | (least == keys[i[here]])
    return out


def _tree_pairs(members: DataFrame, threshold: Fraction, nearest: bool) -> DataFrame:
    """Pairs (key, a, b, likeness), with the bound on the similarity, of nodes that the cells' trees leave, from (key, part, node, half, label, size, point, early).

    Members of a cell come together, and a cell part has at most about two blocks of nodes.  nearest:
    each node gives only the pair of the highest bound in a cell, so the pairs are no more than the rows.
    """
    schema = "key long, a long, b long, likeness double"
    p, q = threshold.numerator, threshold.denominator

    def flush(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs of whole cells."""
        cell, nodes = rows["cell"], rows["node"]
        starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))
        lengths = np.diff(np.append(starts, len(cell)))
        found = []
        two = starts[lengths == 2]
        for i, shared in _overlaps(rows["flat"], rows["start"], rows["length"], two[rows["label"][two] != rows["label"][two + 1]]):
            sizes = rows["size"][i].astype(np.int64) + rows["size"][i + 1]
            good = (shared * (p + q) >= p * sizes) & first_met(rows["early"], cell[:, 0], i, i + 1)
            found.append((i[good], i[good] + 1, shared[good] / sizes[good]))
        for s, n in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
            here = slice(s, s + n)
            if (rows["label"][here] == rows["label"][s]).all():
                continue
            halves, sizes = rows["half"][here], rows["size"][here]
            points = folded(rows["flat"], rows["start"][here], rows["length"][here])
            pairs = []
            for i, j in Tree(points, sizes).pairs(rows["label"][here], threshold, halves if halves.any() else None):
                new = first_met(rows["early"], cell[:, 0], i + s, j + s)
                pairs.append((i[new], j[new]))
            if pairs:
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                like = overlap(points, points, i, j) / (sizes[i] + sizes[j])
                if nearest:
                    i, j, like = _nearest(i, j, like)
                found.append((i + s, j + s, like))
        if not found:
            return
        i, j, like = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(cell[i, 0]), pa.array(a), pa.array(b), pa.array(like)], ["key", "a", "b", "likeness"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("point").to_pylist()
            early = np.full((batch.num_rows, EARLY), np.iinfo(np.int64).max)
            for row, keys in enumerate(batch.column("early").to_pylist()):
                early[row, : len(keys)] = keys
            now = {
                "cell": np.stack([batch.column("key").to_numpy(), batch.column("part").to_numpy()], axis=1),
                "early": early,
                **{k: batch.column(k).to_numpy() for k in ("node", "label", "half", "size")},
                "length": np.array([len(x) for x in raw], np.int64),
            }
            flat = np.frombuffer(b"".join(raw), np.uint8)
            if held:
                flat = np.concatenate([held.pop("flat"), flat])
                now = {k: np.concatenate([held[k], v]) for k, v in now.items()}
            now["start"] = np.cumsum(now["length"]) - now["length"]
            last = np.flatnonzero((now["cell"] != now["cell"][-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from flush({k: v[:cut] for k, v in now.items()} | {"flat": flat})
            held = {k: v[cut:].copy() for k, v in now.items() if k != "start"} | {"flat": flat[now["start"][cut] :].copy()}
        if held:
            yield from flush(held | {"start": np.cumsum(held["length"]) - held["length"]})

    spark = members.sparkSession
    dealt = members.repartition(common.partitions(spark), "key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.select("key", "part", "node", "label", "half", "size", "point", "early").mapInArrow(run, schema)


def _joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node (u) that the task's edges join to a smaller one, with the smallest (v)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component), written: the smallest node that links (a, b) lead to, for every node with a link.

    Every task joins up to about EDGES_A_TASK edges; where that takes more than one, large and small stars
    alternate, and every round writes its edges to the shared folder.
    """
    few = lambda df: common.materialise(df.coalesce(tasks))
    tasks = max(1, -(-links.count() // EDGES_A_TASK))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    edges = common.materialise(edges.coalesce(tasks).mapInArrow(_joined_in_task, "u long, v long").where("u > v"))
    before, done = None, tasks == 1
    while not done:
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours go to the least of them
        lowest = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = few(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        common.drop(edges, least, large, lowest)
        edges = after
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.countDistinct("u").alias("d")).first()
        done = before == now and now["n"] == now["d"]
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _best_of_each(pairs: DataFrame) -> DataFrame:
    """The likeliest pair (a, b) of every node: no more pairs than nodes."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("likeness", "a", "b").alias("pair"))
    return ends.groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def _unsettled(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, label, part, half) of the members of cells with two labels or more, a row a cell part; the table it reads."""
    labelled = common.materialise(members.join(labels.withColumnRenamed("component", "label"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("size")).where("l0 < l1").select("key", F.ceil(F.col("size") / CELL_BLOCK).cast("int").alias("blocks"))
    rest = (
        labelled.join(mixed, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # a pair of different blocks has the lower one as one half; a block with itself has no halves
        .select("key", "node", "label", (F.least("block", "with").cast("long") * F.col("blocks") + F.greatest("block", "with")).alias("part"), (F.col("block") < F.col("with")).cast("int").alias("half"))
    )
    return rest, labelled


def linked(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two rows link when their sets of n-word shingles have Jaccard similarity of threshold or more;
    component_id is the smallest doc_id that links lead to, the row's own included.
    """
    return connected(docs, sets_of(docs, n, Slices(threshold)), n, threshold)


def connected(docs: DataFrame, found: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """linked(), with cells given: found is what sets_of() gives, and links are sought in cells only."""
    return classes(docs, found, n, threshold).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, found: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row: connected(), with the texts' hashes."""
    rows, groups = _grouped(docs, found, n, threshold)
    names = common.materialise(groups.groupBy("group").agg(F.min("first_id").alias("component_id")))
    final = common.materialise(groups.join(names, "group").select("node", "component_id"))
    common.drop(groups, names)
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(final, "node", "left").select("doc_id", "text_key", "n_shingles", alone.alias("component_id"))


def representatives(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(doc_id, text_key, times), written: the document of each group that stands for it, and how many rows are it.

    It is the one of the smallest doc_id, null last, then text_key.  Rows without words are in no group.
    """
    rows, groups = _grouped(docs, sets_of(docs, n, Slices(threshold)), n, threshold)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("first_id").isNull().alias("absent"), "first_id", "text_key")).alias("best")).select("best.first_id", "best.text_key")
    times = rows.where("node is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    same = best["first_id"].eqNullSafe(times["doc_id"]) & (best["text_key"] == times["text_key"])
    out = common.materialise(times.join(best, same, "left_semi"))
    common.drop(rows, groups)
    return out


def _grouped(docs: DataFrame, found: DataFrame, n: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, node) of every row and (node, first_id, text_key, group) of every node, both written."""
    parts = common.partitions(docs.sparkSession)
    sets = common.materialise(found)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key"))
    firsts = common.materialise(sets.where("node is not null").groupBy("node").agg(first.alias("first")).select("node", F.col("first.doc_id").alias("first_id"), "first.text_key"))

    dealt = sets.where("node is not null").select(F.explode("keys").alias("key"), "node").repartition(parts, "key")
    shared = dealt.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot < other").select("key", "pivot")
    every = common.materialise(dealt.join(shared, "key").select("key", "node", "pivot").distinct())
    rows = common.materialise(sets.select("doc_id", "text_key", "n_shingles", "node"))
    # cells with the same nodes are one, named by the least of their keys; weight: how many they are
    digest = [F.count(F.lit(1)).alias("size"), *(F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"d{seed}") for seed in (1, 2))]
    alike = every.groupBy("key").agg(*digest).groupBy("size", "d1", "d2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).select("key", "weight")
    members = common.materialise(every.join(alike, "key"))
    common.drop(every)

    # the points of the nodes that share a cell, with their least keys
    early = members.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, EARLY).alias("early"))
    points = sets.where("point is not null").select("node", F.col("n_shingles").cast("int").alias("size"), "point")
    known = common.materialise(points.join(early, "node").dropDuplicates(["node"]))
    common.drop(sets)

    # the star: each node against the node that leads most of its cells
    meets = members.where("node > pivot").groupBy("node", "pivot").agg(F.sum("weight").alias("times"))
    star = meets.groupBy("node").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot"))
    tested = common.materialise(star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
    near = common.materialise(_possible(tested, known, threshold))
    links = _verified(near, docs, firsts, n, threshold)
    common.drop(near)
    labels = components(links)

    # the trees: each node's nearest only, while these link; then, with what that has joined, all pairs of different labels
    nearest, open_ = True, members.select("key", "node")
    while True:
        rest, written = _unsettled(open_, labels)
        raw = common.materialise(_tree_pairs(rest.join(known, "node"), threshold, nearest))
        pairs = raw.groupBy("a", "b").agg(F.max("likeness").alias("likeness")).join(tested, ["a", "b"], "left_anti")
        todo = common.materialise((_best_of_each(pairs) if nearest else pairs).select("a", "b"))
        new = _verified(todo, docs, firsts, n, threshold)
        asked, joined = todo.count(), new.count()
        links, old = common.materialise(links.unionByName(new)), links
        tested, before = common.materialise(tested.unionByName(todo)), tested
        # a cell that names no pair now names none later: labels only merge
        open_ = common.materialise(members.select("key", "node").join(raw.select("key").distinct(), "key", "left_semi"))
        common.drop(written, raw, todo, new, old, before)
        if joined:
            common.drop(labels)
            labels = components(links)
        if not nearest or not asked:
            break
        nearest = joined >= PRODUCTIVE * asked
    common.drop(members, known, links, tested)

    groups = common.materialise(firsts.join(labels, "node", "left").select("node", "first_id", "text_key", F.coalesce("component", "node").alias("group")))
    common.drop(labels, firsts)
    return rows, groups


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"), 3, Fraction(9, 10))
