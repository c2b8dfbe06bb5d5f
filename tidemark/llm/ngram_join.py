"""N-gram Jaccard join by parity sketches: documents whose word-shingle sets overlap enough, and their classes.

Texts with equal sets are one node. For the rest:

* **Pigeonhole.** Sets of a and b shingles with Jaccard ``p/q`` or more differ in at most ``D = (a + b)(q - p)/(q + p)`` shingles. In a size
  band every shingle falls into one of ``B`` blocks, and a block keeps a 64-bit parity sketch of its shingles: each flips a random half of the
  bits, so equal sketches mean equal blocks. A differing shingle spoils one block, so of any ``D + 1 + s`` blocks at least ``s + 1`` agree:
  one more than the empty blocks that a node skips (a node with more empty ones emits those as well). No linked pair is lost. A node emits a
  prefix of the blocks in its own band and, near the upper end, in the next.
* **Sketch bound.** A whole set has a longer parity sketch, one bit flipped a shingle, whose Hamming distance is a lower bound of the
  difference. Every candidate passes that bound before it is verified exactly.
* **Stars.** Nodes that share a block are candidates, but are not paired off. The best connected one nearby is a node's pivot, and each node is
  verified against its pivot only: as many pairs as nodes. Verified links make components. Large blocks that still hold several components choose
  new pivots from their largest one, round after round while that links enough.
* **The rest.** In blocks that still hold several components, nodes of different ones are compared by their sketches inside tasks, large blocks
  chunk against chunk. A task emits no pairs but the nodes that have a passing partner in another component. These meet once more with their sets;
  the tasks verify exactly and emit a spanning forest of links (fewer than they have components).

Shingle sets are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import as_long, cut, free_name, grams, key_bitmap, mix, slices, stored, texts, with_bitmap, word_hashes

WIDTH, PERCENT = 4, 85
#: Upper ends of the size bands grow by this factor.
BAND = 1.5
#: Nodes of a block, and shingles of their sets, that a task compares with as many others at once. Smaller units are compared many at a time.
CHUNK, CHUNK_SHINGLES, SMALL = 1024, 1 << 19, 16
#: Members of one pivot that a task verifies.
STAR = 64
#: Another round of stars follows one in which at least one tested node in so many was linked.
WORTH = 8


class Bands:
    """Sizes, blocks and bounds of the pigeonhole for a threshold of ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.edges = np.array(edges, dtype=np.int64)

    def bound(self, total: int) -> int:
        """The most shingles in which two linked sets of this total size can differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def spare(self, bound: int) -> int:
        return 2 + bound // 32

    def groups(self, n: int) -> list[tuple[int, int, int]]:
        """(group, blocks of the group, blocks that a set of n emits there)."""
        j = int(np.searchsorted(self.edges, n, "right")) - 1
        out = []
        for g in (j, j + 1):
            low, top = int(self.edges[g]), int(self.edges[g + 1]) - 1
            if g > j and 100 * n < self.percent * low:
                break
            most = self.bound(2 * top)
            own = self.bound(n + min(top, 100 * n // self.percent))
            if own:
                out.append((g, most + 1 + self.spare(most), own + 1 + self.spare(own)))
        return out

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Hashed (group, block, XOR of the block's shingles), one for each emitted block."""
        out = []
        placed, coded = shingles >> np.uint64(32), mix(shingles)
        for group, blocks, wanted in self.groups(len(shingles)):
            block = ((placed * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)  # sorted, as shingles are
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            full = block[edges]
            value = np.bitwise_xor.reduceat(coded, edges)
            inside = full < wanted
            full, value = full[inside], value[inside]
            if wanted - len(full) > self.spare(self.bound(len(shingles) + min(int(self.edges[group + 1]) - 1, 100 * len(shingles) // self.percent))):
                empty = np.setdiff1d(np.arange(wanted), full)
                full, value = np.append(full, empty), np.append(value, np.zeros(len(empty), np.uint64))
            out.append(mix(value + mix(full.astype(np.uint64) + np.uint64(group << 40))))
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def words(self, n: int) -> int:
        """64-bit words of the parity sketch of a set of n: a power of two, about 8 bits for each shingle of the bound."""
        return 1 << max(0, (max(1, self.bound(2 * n) // 8) - 1).bit_length())

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """The 64-bit words by which whole sets are compared before they are verified."""
        return parity(shingles, self.words(len(shingles)))

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of sketches of as many words, along the last axis."""
        return np.bitwise_count(a ^ b).sum(-1)

    def limit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distance that sketches of two linked sets of these sizes keep."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def apart(self, a: np.ndarray, b: np.ndarray) -> int:
        """Distance of two sketches, the longer one folded."""
        words = min(len(a), len(b))
        return int(self.differ(fold(a, words), fold(b, words)))


def parity(shingles: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch: every shingle flips one bit. Halving it by XOR gives the sketch of half as many words."""
    at = (shingles & np.uint64(words - 1)).astype(np.int64)
    bit = np.uint64(1) << ((shingles >> np.uint64(32)) & np.uint64(63))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, at, bit)
    return out


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def shingle_sets(text: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: lower-cased A-Z, all words as one shingle where there are fewer than ``width``."""
    hashes, offsets = word_hashes(pc.ascii_lower(text))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            yield np.unique(mix(grams(hashes[a:b], width)))
        elif n:
            yield mix(grams(hashes[a:b], n) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)


def node_of(shingles: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """The name of a set: a 64-bit hash, or a second one where different sets share the first."""
    first = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return check_of(shingles) if first in shared else first


def check_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=1)


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), *(x.alias(c) for c, x in _row_keys(doc_id, text).items()), text.alias("text"))


def _row_keys(doc_id: Column, text: Column) -> dict[str, Column]:
    """Two 64-bit hashes that stand for a row where rows are kept or dropped; the first alone names the text of a node."""
    return {"row_key": F.xxhash64(doc_id, text), "row_check": F.xxhash64(F.lit(1), text, doc_id)}


def _nodes(keyed: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key, row_check, node (null without words), a second hash of the set and its size, one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=2 << 20):
            sets = list(shingle_sets(texts(batch), width))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            nodes = as_long(np.fromiter(map(node_of, sets), np.uint64, len(sets)))
            checks = as_long(np.fromiter(map(check_of, sets), np.uint64, len(sets)))
            own = [batch.column(c) for c in ("doc_id", "row_key", "row_check")]
            yield pa.RecordBatch.from_arrays([*own, pc.if_else(pa.array(sizes > 0), nodes, None), checks, pa.array(sizes)], ["doc_id", "row_key", "row_check", "node", "set_check", "n"])

    return keyed.mapInArrow(run, "doc_id long, row_key long, row_check long, node long, set_check long, n long")


def _told_apart(base: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """Sets are told apart by 128 bits: where different ones share their first hash, the second names them. Such hashes come to the driver: n sets have some n^2 / 2^65 (three of ten billion sets)."""
    shared = base.where("node is not null").groupBy("node").agg(F.min("set_check").alias("a"), F.max("set_check").alias("b")).where("a <> b").select("node")
    found = [r.node for r in shared.collect()]
    named = base.withColumn("node", F.when(F.col("node").isin(found), F.col("set_check")).otherwise(F.col("node"))) if found else base
    return named.drop("set_check"), frozenset(x % (1 << 64) for x in found)


def _signatures(keyed: DataFrame, width: int, bands: Bands, shared: frozenset[int] = frozenset()) -> DataFrame:
    """(key, node) of every emitted block; copies within a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=2 << 20):
            own = {node_of(s, shared): s for s in shingle_sets(texts(batch), width) if len(s)}
            keys = [bands.signatures(s) for s in own.values()]
            if keys:
                nodes = np.repeat(np.fromiter(own, np.uint64, len(own)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate(keys)), as_long(nodes)], ["key", "node"])

    return keyed.select("text").mapInArrow(run, "key long, node long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, node): those of keys with two nodes or more, and links (first node of the key, node).

    Runs over the stream with one row of memory: the first node of the key at hand.
    """
    key = first = last = None
    shown = False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if key is not None:
            keys, nodes = np.append(key, keys), np.append(last, nodes)
            firsts0 = first
        else:
            firsts0 = nodes[0]
        new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
        keys, nodes = keys[new], nodes[new]
        start = np.append(True, keys[1:] != keys[:-1])
        group = np.cumsum(start) - 1
        firsts = nodes[start]
        firsts[0] = firsts0
        sizes = np.bincount(group)
        live = (sizes > 1)[group]
        carried = key is not None and keys[0] == key
        if carried and firsts0 != nodes[0]:
            live[group == 0] = True
        emit = live.copy()
        if carried and shown:
            emit[0] = False  # it left with the batch before
        a, b = [keys[emit]], [nodes[emit]]
        edge = [np.zeros(int(emit.sum()), bool)]
        if carried and live[0] and not shown and firsts0 != nodes[0]:
            a.append(keys[:1]), b.append(np.array([firsts0])), edge.append(np.zeros(1, bool))
        link = emit & (firsts[group] != nodes)
        pairs = np.unique(np.stack([firsts[group][link], nodes[link]]), axis=1)
        a.append(pairs[0]), b.append(pairs[1]), edge.append(np.ones(pairs.shape[1], bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(edge))], ["a", "b", "edge"])
        key, first, last = keys[-1], firsts[group[-1]], nodes[-1]
        shown = bool(live[-1])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with links (a, b): the smallest node reachable. Labels spread to neighbours and jump to
    their label's label in each round, so the rounds grow with the logarithm of a path's length."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        upper = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = stored(lower.join(upper, "component", "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("was <> component").isEmpty():
            return labels


def _verify_stars(percent: int, width: int, bands: Bands):
    """Rows sorted by (pivot, salt), the pivot's first: every member against its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, outline = None, np.empty(0, np.uint64), np.empty(0, np.uint64)
        for batch in slices(batches, max_bytes=2 << 20):
            cols = [batch.column(c).to_pylist() for c in ("pivot", "salt", "leads")]
            nodes, pivots, linked, sizes, sketches = [], [], [], [], []
            for pivot, salt, leads, node, shingles in zip(*cols, batch.column("node").to_pylist(), shingle_sets(texts(batch), width), strict=True):
                sketch = bands.sketch(shingles)
                if leads:
                    now, held, outline = (pivot, salt), shingles, sketch
                    if salt:
                        continue
                elif now != (pivot, salt):
                    raise ValueError("a star came without its pivot")
                nodes.append(node), pivots.append(pivot), sizes.append(len(shingles)), sketches.append(sketch.tobytes())
                linked.append(not leads and bands.apart(outline, sketch) <= bands.limit(len(held), len(shingles)) and alike(held, shingles, percent))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(pivots, pa.int64()), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["node", "pivot", "linked", "n", "sketch"])

    return run


def _fetch(keyed: DataFrame, bases: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with a column node) with one text of each node. Rows of other texts are left out before the shuffle."""
    rows = cut(wanted.join(bases, "node"))
    near = with_bitmap(keyed.select("row_key", "text"), "row_key", key_bitmap(rows, "row_key")).where("maybe").drop("maybe")
    return near.join(rows, "row_key").drop("row_key")


class Joined:
    """Components that a task has found to be one, and the order in which they were joined."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.log: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        while (y := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[b] = a
            self.log.append((a, b))
        return a != b


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units and the row where each begins; rows come sorted by (key, x, y), and a unit is two chunks of a block."""
    waiting: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        if not len(rows):
            continue
        marks = [rows.column(c).to_numpy() for c in ("key", "x", "y")]
        edges = np.append(0, np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1)
        if len(edges) > 1:  # the last unit may go on in the next batch
            yield rows.slice(0, edges[-1]).combine_chunks(), edges[:-1]
        waiting = rows.slice(edges[-1]).combine_chunks()
    if waiting is not None and len(waiting):
        yield waiting, np.zeros(1, np.int64)


def _distances(sketches: list[bytes], a: np.ndarray, b: np.ndarray, bands: Bands) -> np.ndarray:
    """Sketch distances of many pairs of rows."""
    flat = np.frombuffer(b"".join(sketches), np.uint64)
    width = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
    first = np.cumsum(width) - width
    out = np.zeros(len(a), np.int64)
    for wide in np.unique(width).tolist():
        for other in np.unique(width).tolist():
            at = np.flatnonzero((width[a] == wide) & (width[b] == other))
            if len(at):
                halves = [flat[first[rows[at]][:, None] + np.arange(w)].reshape(len(at), -1, min(wide, other)) for rows, w in ((a, wide), (b, other))]
                left, right = (np.bitwise_xor.reduce(h, axis=1) for h in halves)  # folding a sketch is the XOR of its pieces
                out[at] = bands.differ(left, right)
    return out


def _small_pairs(rows: pa.Table, edges: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components in small units that the sketches let pass."""
    a, b = [], []
    for size in range(2, SMALL + 1):
        units = edges[sizes == size]
        i, j = np.triu_indices(size, 1)
        a.append((units[:, None] + i).ravel()), b.append((units[:, None] + j).ravel())
    a, b = np.concatenate(a), np.concatenate(b)
    n, side, component, x, y = (rows.column(c).to_numpy() for c in ("n", "side", "component", "x", "y"))
    fit = (component[a] != component[b]) & ((x[a] == y[a]) | (side[a] != side[b])) & (100 * np.minimum(n[a], n[b]) >= bands.percent * np.maximum(n[a], n[b]))
    a, b = a[fit], b[fit]
    passed = _distances(rows.column("sketch").to_pylist(), a, b, bands) <= bands.limit(n[a], n[b])
    return a[passed], b[passed]


def _passing(unit: pa.Table, joined: Joined, bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, other rows, their distances) of pairs of different components that the sketches let pass; the rows of the largest component do not start any."""
    n, side, component = (unit.column(c).to_numpy() for c in ("n", "side", "component"))
    sketches = [np.frombuffer(x, np.uint64) for x in unit.column("sketch").to_pylist()]
    width = min(map(len, sketches))
    flat = np.stack([fold(x, width) for x in sketches])
    names, at = np.unique(component, return_inverse=True)
    largest = np.bincount(at).argmax()
    x, y = unit.column("x")[0].as_py(), unit.column("y")[0].as_py()
    now, read = np.array([joined.top(c) for c in names.tolist()]), len(joined.log)
    for i in np.flatnonzero(at != largest).tolist():
        for kept, gone in joined.log[read:]:
            now[now == gone] = kept
        read = len(joined.log)
        others = np.flatnonzero((now[at] != now[at[i]]) & ((side == side[i]) if x == y else (side != side[i])))
        others = others[100 * np.minimum(n[others], n[i]) >= bands.percent * np.maximum(n[others], n[i])]
        # a pair of two such rows would come twice
        others = others[(at[others] == largest) | (others < i)]
        distance = bands.differ(flat[others], flat[i])
        passed = distance <= bands.limit(n[others], n[i])
        if passed.any():
            yield i, others[passed], distance[passed]


def _open(bands: Bands):
    """The rows that have a passing partner of another component in their unit."""
    names = ["key", "x", "y", "side", "node", "component", "n", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _whole_units(batches):
            sizes = np.diff(np.append(edges, len(rows)))
            marked = np.zeros(len(rows), bool)
            for at in _small_pairs(rows, edges, sizes, bands):
                marked[at] = True
            for start, size in zip(edges[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                for i, others, _ in _passing(rows.slice(start, size), Joined(), bands):
                    marked[start + i] = marked[start + others] = True
            yield from rows.select(names).filter(pa.array(marked)).combine_chunks().to_batches()

    return run


def _unit_links(bands: Bands):
    """Links (a, b), verified on the sets: a spanning forest of those between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for rows, edges in _whole_units(batches):
            found = []
            for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
                unit = rows.slice(start, stop - start)
                nodes, component, sets = unit.column("node").to_pylist(), unit.column("component").to_pylist(), unit.column("shingles")
                for i, others, distance in _passing(unit, joined, bands):
                    own = np.frombuffer(sets[i].as_py(), np.uint64)
                    for j in others[np.argsort(distance, kind="stable")].tolist():
                        if joined.top(component[i]) != joined.top(component[j]) and alike(own, np.frombuffer(sets[j].as_py(), np.uint64), bands.percent):
                            joined.join(component[i], component[j])
                            found.append((nodes[i], nodes[j]))
            yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def _sketch_filter(bands: Bands):
    """The pairs that the sketches let pass, with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [bands.apart(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            distance, na, nb = np.array(near, dtype=np.int64), batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            passed = distance <= bands.limit(na, nb)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(passed)), batch.column("b").filter(pa.array(passed)), pa.array(distance[passed])], ["a", "b", "distance"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingle_sets(texts(batch), width)], pa.binary())], ["node", "shingles"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sa", "sb")), strict=True)
            yield _pairs([(a, b) for a, b, s, t in pairs if alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent)])

    return run


def _star_links(keyed: DataFrame, bases: DataFrame, live: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Each candidate node against its pivot: node, pivot, linked, n, sketch."""
    rank = live.where("not edge").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("rank"))
    edges = live.where("edge").select("a", "b").distinct()
    # the node of most shared blocks around each first node
    around = edges.select("a", F.col("b").alias("node")).unionByName(edges.select("a", F.col("a").alias("node")).distinct())
    best = around.join(rank, "node").groupBy("a").agg(F.max(F.struct("rank", "node")).alias("best"))
    # a node that is its own pivot leads a star, also where no other node chose it
    chosen = cut(around.join(best, "a").groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.node").alias("pivot")))
    stars = chosen.groupBy("pivot").agg(F.greatest(F.ceil(F.count_if(F.col("node") != F.col("pivot")) / STAR), F.lit(1)).cast("int").alias("salts"))
    members = chosen.where("node <> pivot").join(stars, "pivot").select("node", F.struct("pivot", F.expr("int(pmod(xxhash64(node), salts))").alias("salt"), F.lit(False).alias("leads")).alias("place"))
    leaders = stars.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("node", F.struct(F.col("node").alias("pivot"), "salt", F.lit(True).alias("leads")).alias("place"))
    places = members.unionByName(leaders).groupBy("node").agg(F.collect_list("place").alias("places"))
    rows = _fetch(keyed, bases, places).select("node", "text", F.explode("places").alias("p")).select("node", "text", "p.*")
    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("leads"))
    return dealt.select("node", "text", "pivot", "salt", "leads").mapInArrow(_verify_stars(bands.percent, width, bands), "node long, pivot long, linked boolean, n long, sketch binary")


def _sets_of(keyed: DataFrame, bases: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes of ``ends``."""
    return _fetch(keyed, bases, ends.select("node").distinct()).select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets(width), "node long, shingles binary")


def _verified(keyed: DataFrame, bases: DataFrame, near: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    near = cut(near)
    sets = cut(_sets_of(keyed, bases, near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), width))
    both = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return cut(both.mapInArrow(_exact(percent), "a long, b long"))


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, component) with the components that ``links`` (a, b) connect made one."""
    ends = links.join(known.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    top = components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return stored(known.join(top, "component", "left").select("node", F.coalesce("joined", "component").alias("component")))


def _mixed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(key, node, component, c) of the blocks that hold several components, with their number of nodes; of blocks with the same nodes one is enough."""
    now = rows.select("key", "node").join(known, "node")
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"s{i}") for i in range(2)]
    several = now.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("c"), *same).where("p <> q")
    several = several.groupBy("s0", "s1", "c").agg(F.min("key").alias("key")).select("key", "c")
    return stored(now.join(several, "key").select("key", "node", "component", "c"))


def _pivot_links(mixed: DataFrame, info: DataFrame, salt: int, bands: Bands) -> DataFrame:
    """One candidate link (a, b) at most for each node outside its block's largest component: the nearest of that component's two new pivots in its blocks."""
    pivots = [F.min_by("node", F.xxhash64("node", F.lit(2 * salt + i))) for i in range(2)]
    groups = mixed.groupBy("key", "component").agg(F.count("*").alias("c"), F.array_distinct(F.array(*pivots)).alias("pivots"))
    top = cut(groups.groupBy("key").agg(F.max(F.struct("c", "component", "pivots")).alias("m")))
    tests = mixed.join(top, "key").where("component <> m.component").select(F.col("node").alias("a"), F.explode("m.pivots").alias("b")).distinct()
    one, two = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = cut(tests).join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {bands.percent} * greatest(na, nb)").mapInArrow(_sketch_filter(bands), "a long, b long, distance long")
    return near.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))


def _in_units(mixed: DataFrame, info: DataFrame) -> DataFrame:
    """Each row once for every unit of its block, with its sketch."""
    sizes = stored(mixed.join(info.select("node", "n"), "node").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks")))
    chunk = F.expr("transform(sequence(0, chunks - 1), z -> struct(least(side, z) AS x, greatest(side, z) AS y))")
    rows = mixed.join(sizes, "key").withColumn("side", F.expr("int(pmod(xxhash64(node), chunks))"))
    # sketches come last, as they are what takes room
    rows = rows.select("key", "side", "node", "component", F.explode(chunk).alias("u")).select("key", "u.x", "u.y", "side", "node", "component")
    return rows.join(info, "node").select("key", "x", "y", "side", "node", "component", "n", "sketch")


def _by_unit(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _classes(keyed: DataFrame, bases: DataFrame, live: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(node, component) of the candidates, from the shared blocks."""
    stars = cut(_star_links(keyed, bases, live, width, bands))
    info = stored(stars.dropDuplicates(["node"]).select("node", "n", "sketch"))
    known = _merged(info.select("node", F.col("node").alias("component")), stars.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    mixed = _mixed(live.where("not edge").select(F.col("a").alias("key"), F.col("b").alias("node")), known)
    for salt in range(1, 1 << 30):
        large = mixed.where(F.col("c") > SMALL)
        tested = large.select("node").distinct().count()
        if not tested:
            break
        links = _verified(keyed, bases, _pivot_links(large, info, salt, bands), width, bands.percent)
        known = _merged(known, links)
        mixed = _mixed(mixed, known)
        if links.count() * WORTH < tested:
            break
    if mixed.isEmpty():
        return known
    left = cut(_by_unit(_in_units(mixed, info)).mapInArrow(_open(bands), "key long, x int, y int, side int, node long, component long, n long, sketch binary"))
    # an open row meets the same rows again, now with the sets
    sets = cut(_sets_of(keyed, bases, left, width))
    links = _by_unit(left.join(sets, "node").select(*left.columns, "shingles")).mapInArrow(_unit_links(bands), "a long, b long")
    return _merged(known, cut(links))


def similar_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: Bands | None = None) -> DataFrame:
    """Classes of documents linked by similarity: ``doc_id row_key row_check n_shingles component_id class_key``, one row for each row.

    ``component_id`` is the smallest doc_id reachable by links, the row's own included. A text without words (or null) is
    linked with nothing. Rows with equal sets, also under one id, are linked. ``class_key`` tells classes apart where rows of one id are in several (null without words). A null id never names a class unless nothing else is in it.
    Other columns are not read. ``bands`` may bring other blocks and sketches than parity sketches.
    """
    bands = bands or Bands(percent)
    keyed = _keyed(docs)
    base, shared = _told_apart(cut(_nodes(keyed, width)))
    classes = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"))
    bases = classes.select("node", "row_key")
    live = cut(_signatures(keyed, width, bands, shared).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "a long, b long, edge boolean"))
    labels = _classes(keyed, bases, live, width, bands)
    named = classes.select("node", "least_id").join(labels, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    final = named.join(first, "component").select("node", "component", "component_id")
    out = base.join(final, "node", "left")
    return out.select("doc_id", "row_key", "row_check", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("component").alias("class_key"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, with one row of each class: of the smallest doc_id (nulls last), and of rows with that id the one of the smallest hash.

    Of rows equal in id and text the one whose other columns come first in order stays (nulls first, columns without an order left out of it).
    Documents without words stay, as they are linked with nothing.
    """
    classes = cut(similar_classes(docs, width, percent))
    names = {c: free_name(docs, c) for c in ("row_key", "row_check")}
    own = [F.col(c).alias(x) for c, x in names.items()]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "row_check")).alias("m")
    leaders = classes.where("n_shingles > 0").groupBy("class_key").agg(first).select("m.*").select(*own)
    empty = classes.where("n_shingles = 0").select(*own).distinct()
    keyed = docs.withColumns({names[c]: x for c, x in _row_keys(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).items()})
    ordered = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, MapType | VariantType)]
    kept = keyed.join(leaders, list(names.values()), "left_semi").groupBy(*names.values()).agg(F.min_by(F.struct(*docs.columns), F.struct(F.lit(0), *ordered)).alias("m")).select("m.*")
    return kept.unionByName(keyed.join(empty, list(names.values()), "left_semi").select(*docs.columns))
