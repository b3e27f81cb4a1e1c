"""The diffusion component of a graph: the second eigenvector of its density-normalised transition matrix.

A block of vectors is multiplied by the matrix again and again (block Lanczos): a product is made orthogonal to the
two blocks before it and is the next block, and the best vector of all blocks is found from their inner products,
small matrices that tasks add up.  Matrix and vectors are tiles: a part of a tile holds ENTRIES entries or so and meets
the vectors of its columns.  No task holds the graph or a vector.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.shared import folder, written

from .ordering import running_total

#: What is said of a graph without a component.
APART, SLOW = "the graph isn't connected", "the component didn't converge"
#: Entries of a part of a tile.
ENTRIES = 1 << 18
#: Of a squared length, what is less than this share of it is rounding.
ROUNDING = 1e-13
#: A tile of vectors: its nodes' factors c and first eigenvector q, the block before the last, the last, and its product; binary columns are doubles, a vector after the other.
STATE = "tile long, c binary, q binary, prev binary, v binary, w binary, inner binary"


def averaged(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """source, target, w of edges (source, target, weight): both directions of a pair are averaged, a missing one counts 0, and weights that aren't positive numbers are no edges.  Rows of a pair add up, in so many tasks, or as Spark has it."""
    sound = edges.where("weight > 0 AND weight < double('infinity') AND source IS NOT NULL AND target IS NOT NULL")
    rows = sound.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight")
    pairs = (rows.repartition(tasks, "a", "b") if tasks else rows).groupBy("a", "b").agg(F.sum("weight").alias("w"))
    ends = pairs.withColumn("source", F.explode(F.array_distinct(F.array("a", "b"))))
    target = F.when(F.col("source") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return written(ends.select("source", target.alias("target"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(F.col("w") / 2).alias("w")))


def is_apart(both: DataFrame) -> bool:
    """Whether the graph of edges (source, target), each in both directions, has several parts.

    Parts take the least label next to them, all at once, so each pass over the edges leaves half as many or
    fewer; labels, a row a node, are then followed to their ends.
    """
    labels = written(both.select(F.col("source").alias("node")).distinct().withColumn("label", F.col("node")))
    while labels.select("label").distinct().limit(2).count() == 2:
        beside = both.join(labels.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.min("label").alias("beside"))
        to = written(labels.join(beside, "node").groupBy("label").agg(F.min("beside").alias("to")).select("label", F.least("label", "to").alias("to")))
        if to.where("to < label").isEmpty():
            return True
        while True:
            ahead = written(to.join(to.select(F.col("label").alias("to"), F.col("to").alias("next")), "to").select("label", "to", "next"))
            to = ahead.select("label", F.col("next").alias("to"))
            if ahead.where("next < to").isEmpty():
                break
        labels = written(labels.join(to, "label").select("node", F.col("to").alias("label")))
    return False


def normalised(both: DataFrame) -> DataFrame:
    """node, at, c, q of averaged edges: at numbers the nodes from 0, c is the factor of both a weight's ends in the transition matrix in its symmetric form, and q the matrix's first eigenvector, not scaled.

    Each weight is first divided by both ends' sums, then by the roots of both ends' sums of what that gives.
    """
    sums = written(both.groupBy(F.col("source").alias("node")).agg(F.sum("w").alias("s")))
    dense = both.join(sums.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.sum(F.col("w") / F.col("s")).alias("d"))
    nodes = sums.join(dense, "node").select("node", "s", F.sqrt(F.col("d") / F.col("s")).alias("q"))
    return written(running_total(nodes, [], ["node"], name="at").select("node", "at", (1 / (F.col("s") * F.col("q"))).alias("c"), "q"))


def tiled(both: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """tile, beside, at, w: the matrix of averaged edges in parts of tiles of 2**bits rows and columns; at holds, in order, a row and a column within the tile for each w."""
    ends, mask = nodes.select("node", "at"), (1 << bits) - 1
    pairs = both.join(ends.toDF("source", "a"), "source").join(ends.toDF("target", "b"), "target")
    place = F.shiftleft(F.col("a").bitwiseAND(F.lit(mask)), bits) + F.col("b").bitwiseAND(F.lit(mask))
    placed = pairs.select(F.shiftright("a", bits).alias("tile"), F.shiftright("b", bits).alias("beside"), place.cast("int").alias("at"), "w")
    parts = written(placed.groupBy("tile", "beside").agg(F.ceil(F.count("*") / ENTRIES).alias("parts")))
    split = F.pmod(F.xxhash64("at"), "parts")  # under 2**12, as a tile has 2**30 places

    def packed(rows: pa.Table) -> pa.Table:
        order, key = np.argsort(rows["at"].to_numpy()), rows["key"][0].as_py()
        return pa.table({"tile": [key >> 38], "beside": [key >> 12 & (1 << 26) - 1], **{c: [rows[c].to_numpy()[order].tobytes()] for c in ("at", "w")}})

    key = F.shiftleft("tile", 38) + F.shiftleft("beside", 12) + split  # one number, which is sorted faster than three
    dealt = placed.join(parts, ["tile", "beside"]).select(key.alias("key"), "at", "w").repartition(max(1, -(-both.count() // (2 * ENTRIES))), "key")
    return written(dealt.groupBy("key").applyInArrow(packed, "tile long, beside long, at binary, w binary"))


def _vectors(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, size)


def _row(tile: int, c: np.ndarray, *parts: np.ndarray) -> pa.Table:
    """A row of STATE with the inner products of its tile."""
    x = np.concatenate(parts)
    values = [c, *parts, x @ x.T]
    return pa.table({"tile": [tile], **{n: [v.tobytes()] for n, v in zip(("c", "q", "prev", "v", "w", "inner"), values)}})


def _first_state(nodes: DataFrame, bits: int, scale: float, columns: list) -> DataFrame:
    """STATE whose only block is w, of the given columns."""
    names = [f"w{j}" for j in range(len(columns))]

    def start(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        c, q, *w = (rows[n].to_numpy() for n in ("c", "q", *names))
        return _row(rows["tile"][0].as_py(), c, q[None] / scale, np.zeros((0, len(c))), np.zeros((0, len(c))), np.stack(w))

    rows = nodes.select(F.shiftright("at", bits).alias("tile"), "at", "c", "q", *[x.alias(n) for x, n in zip(columns, names)])
    return written(rows.groupBy("tile").applyInArrow(start, STATE))


def _turned(state: DataFrame, mix: np.ndarray) -> DataFrame:
    """tile, c, q, prev, v: the block v is made of q, prev, v and w by mix, and prev was v."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.concatenate([_vectors(r[n], len(r["c"]) // 8) for n in ("q", "prev", "v", "w")])
                yield pa.RecordBatch.from_pylist([{"tile": r["tile"], "c": r["c"], "q": r["q"], "prev": r["v"], "v": (mix.T @ x).tobytes()}])

    return state.select("tile", "c", "q", "prev", "v", "w").mapInArrow(turn, "tile long, c binary, q binary, prev binary, v binary")


def _multiplied(matrix: DataFrame, turned: DataFrame, bits: int) -> DataFrame:
    """STATE with w, the product of the matrix with v: a part multiplies the vectors of its columns and hands on the rows it has."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                tile, at, w, c, v = (b.column(n)[k] for n in ("tile", "at", "w", "c", "v"))
                at, w, c = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(w.as_buffer()), np.frombuffer(c.as_buffer())
                row, column = at >> bits, (at & ((1 << bits) - 1)).astype(np.intp)
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                y = np.stack([np.add.reduceat(w * x.take(column), starts) for x in _vectors(v.as_buffer(), len(c)) * c])
                yield pa.RecordBatch.from_pydict({"tile": [tile.as_py()], "at": [row[starts].tobytes()], "y": [y.tobytes()]})

    def added(sent: pa.Table, own: pa.Table) -> pa.Table:
        r = own.to_pylist()[0]
        c = np.frombuffer(r["c"])
        q, prev, v = (_vectors(r[n], len(c)) for n in ("q", "prev", "v"))
        w = np.zeros(v.shape)
        for at, y in zip(sent["at"], sent["y"]):
            at = np.frombuffer(at.as_buffer(), np.int32)
            w[:, at] += _vectors(y.as_buffer(), len(at))
        return _row(r["tile"], c, q, prev, v, w * c)

    sent = matrix.join(turned.select(F.col("tile").alias("beside"), "c", "v"), "beside").select("tile", "at", "w", "c", "v").mapInArrow(part, "tile long, at binary, y binary")
    return sent.groupBy("tile").cogroup(turned.groupBy("tile")).applyInArrow(added, STATE)


def _inner(state: DataFrame) -> np.ndarray:
    """All inner products of q, prev, v and w; a task hands on one small matrix."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("inner"):
                x = np.frombuffer(x.as_buffer())
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"inner": [total.tobytes()]})

    total = sum(np.frombuffer(r["inner"]) for r in state.select("inner").mapInArrow(added, "inner binary").collect())
    m = int(round(len(total) ** 0.5))
    return total.reshape(m, m)


def next_block(inner: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the inner products of some vectors, the last of which are a block: how that block less its share in the others is made of them, and the mix that makes an orthonormal block of it, without what is rounding."""
    n = len(inner) - block
    scale = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
    scaled = inner * scale[:, None] * scale
    less = np.concatenate([-np.linalg.lstsq(scaled[:n, :n], scaled[:n, n:], rcond=1e-12)[0], np.eye(block)]) * scale[:, None] / scale[n:]
    size, turned = np.linalg.eigh(less.T @ inner @ less)
    kept = size > ROUNDING * max(np.trace(inner[n:, n:]), 1e-300)
    return less, less @ turned[:, kept] / np.sqrt(size[kept])


@dataclass
class Space:
    """The blocks that begin with a state's w.  Each is written as `step=<number>` of one folder; prods and overlaps hold the inner products of a block with its product and with itself, and of the one before with both."""

    matrix: DataFrame
    state: DataFrame
    bits: int
    block: int
    inner: np.ndarray
    path: str
    sizes: list[int] = field(default_factory=list)
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def of(cls, matrix: DataFrame, state: DataFrame, bits: int, block: int) -> Space:
        return cls(matrix, state, bits, block, _inner(state), f"{folder(state.sparkSession)}/table-{uuid.uuid4().hex}")

    def extended(self) -> bool:
        """Multiplies one more block; False if the blocks are all there is."""
        mix = next_block(self.inner, self.block)[1]
        if not mix.shape[1]:
            return False
        before, self.block = (self.sizes or [0])[-1], mix.shape[1]
        path = f"{self.path}/step={len(self.sizes)}"
        _multiplied(self.matrix, _turned(self.state, mix), self.bits).write.parquet(path)
        self.state = self.state.sparkSession.read.schema(STATE).parquet(path)
        self.inner = _inner(self.state)
        prev, v, w = slice(1, 1 + before), slice(1 + before, 1 + before + self.block), slice(1 + before + self.block, None)
        self.sizes.append(self.block)
        self.tables.append(tuple(self.inner[a, b] for a, b in ((prev, v), (prev, w), (v, v), (v, w))))
        return True

    def best(self) -> tuple[np.ndarray, np.ndarray, float]:
        """The space's values, largest first, its vectors in terms of the blocks, and the residual of the first."""
        ends = np.append(0, np.cumsum(self.sizes))
        s, h = np.zeros((ends[-1], ends[-1])), np.zeros((ends[-1], ends[-1]))
        for k, (prev_v, prev_w, v_v, v_w) in enumerate(self.tables):
            own, before = slice(ends[k], ends[k + 1]), slice(ends[max(k, 1) - 1], ends[k])
            s[own, own], h[own, own] = v_v, (v_w + v_w.T) / 2
            s[before, own], h[before, own], s[own, before], h[own, before] = prev_v, prev_w, prev_v.T, prev_w.T
        root = np.linalg.inv(np.linalg.cholesky(s))
        values, vectors = np.linalg.eigh(root @ h @ root.T)
        vectors = (root.T @ vectors)[:, ::-1]
        left = next_block(self.inner, self.block)[0] @ vectors[ends[-2] :, 0]
        return values[::-1], vectors, float(np.sqrt(max(left @ self.inner @ left, 0)))

    def mixed(self, weights: np.ndarray) -> DataFrame:
        """STATE whose w are the blocks' sums by weights."""
        ends = np.append(0, np.cumsum(self.sizes))

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tile, step, v in zip(*(b.column(n).to_pylist() for n in ("tile", "step", "v"))):
                    own = weights[ends[step] : ends[step + 1]]
                    yield pa.RecordBatch.from_pydict({"tile": [tile], "w": [(own.T @ np.frombuffer(v).reshape(len(own), -1)).tobytes()]})

        def added(shares: pa.Table, own: pa.Table) -> pa.Table:
            r = own.to_pylist()[0]
            c, none = np.frombuffer(r["c"]), np.zeros((0, len(r["c"]) // 8))
            w = np.zeros((weights.shape[1], len(c)))
            for x in shares["w"]:
                w += _vectors(x.as_buffer(), len(c))
            return _row(r["tile"], c, _vectors(r["q"], len(c)), none, none, w)

        blocks = self.state.sparkSession.read.schema("tile long, v binary, step int").parquet(self.path)
        sums = blocks.mapInArrow(share, "tile long, w binary").groupBy("tile").cogroup(self.state.select("tile", "c", "q").groupBy("tile")).applyInArrow(added, STATE)
        return written(sums)


def _by_node(state: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """node, value of a state whose w is one vector."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, w in zip(*(b.column(n).to_pylist() for n in ("tile", "w"))):
                w = np.frombuffer(w)
                yield pa.RecordBatch.from_pydict({"at": (tile << bits) + np.arange(len(w)), "value": w})

    return nodes.select("node", "at").join(state.select("tile", "w").mapInArrow(listed, "at long, value double"), "at").select("node", "value")


def diffusion_component(edges: DataFrame, tolerance: float = 1e-7, rounds: int = 60, block: int = 8, steps: int = 3, seed: int = 42, tasks: int | None = None) -> DataFrame:
    """node, value, note: the component's value at each node that has an edge; NULL and a note where there is none.

    The vector has length 1, and its value of the largest size (ties: the least node) is positive.  A graph
    of several parts, told before anything is multiplied, has no such component, nor one of fewer than two nodes.
    A round is `steps` products of `block` vectors.  What a round finds is multiplied once more by itself, and
    begins the blocks anew if it isn't within the tolerance then.  Edges are added up in `tasks` tasks.
    """
    both = averaged(edges, tasks)
    if is_apart(both):
        return both.select(F.col("source").alias("node")).distinct().select("node", F.lit(None).cast("double").alias("value"), F.lit(APART).alias("note"))
    nodes = normalised(both)
    n, total = nodes.agg(F.count("*"), F.sum(F.col("q") * F.col("q"))).first()
    if n < 2:
        return nodes.select("node", F.lit(None).cast("double").alias("value"), F.lit(APART).alias("note"))
    # tiles of ENTRIES entries where those lie evenly
    bits = int(np.clip(np.round(np.log2(n * np.sqrt(ENTRIES / both.count()))), 9, 15))
    noise = [(F.xxhash64(F.lit(seed + j), "node") % 1000003) / 1000003.0 for j in range(block)]
    space = Space.of(tiled(both, nodes, bits), _first_state(nodes, bits, float(np.sqrt(total)), noise), bits, block)
    note = SLOW
    for _ in range(rounds):
        for _ in range(steps):
            if not space.extended():
                break
        values, vectors, residual = space.best()
        if values[0] > 1 - 1e-9:
            note = APART
            break
        if residual < tolerance:
            chosen = vectors[:, :block]
            space = Space.of(space.matrix, space.mixed(chosen), bits, chosen.shape[1])
            space.extended()
            _, vectors, residual = space.best()
            if residual < tolerance:
                found = written(_by_node(space.mixed(vectors[:, :1]), nodes, bits))
                top = found.agg(F.max_by("value", F.struct(F.abs(F.round("value", 9)), -F.col("node")))).first()[0]
                return found.select("node", (F.col("value") * float(np.sign(top) or 1)).alias("value"), F.lit(None).cast("string").alias("note"))
    return nodes.select("node", F.lit(None).cast("double").alias("value"), F.lit(note).alias("note"))
