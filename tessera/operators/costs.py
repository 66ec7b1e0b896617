"""Least costs from many starts at once. Components that a task can hold are relaxed there, in arrays of nodes by starts.

Larger ones are relaxed in rounds of joins, where a node's costs from 64 starts travel as one row.
A row holds the costs as the bytes of 64-bit floats, by component of the cost and then by start, infinite where a start doesn't reach the node. Starts that follow each
other share rows, so rows of neighbouring starts are full. A round joins the rows that fell to the edges out of their nodes and takes, in tasks that hold a bounded
number of them, minima by number arrays: no row per start, edge and round is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lots import coded, dealt, lots, rest
from tessera.plans.loop import kept

#: Starts whose costs lie in one row, and edges out of a node in one row.
WIDTH, EDGES = 64, 1_024
#: Costs that a task works on at a time.
AT_ONCE = 1 << 21
#: Nodes times starts, and edges times starts at a time, of a task that holds a component.
CELLS = 1 << 21


def _steps(parts: int) -> tuple[Callable, Callable, Callable]:
    """send, merge and flat: functions on batches of rows of costs with so many components."""
    width, size, at_once, schema_of = WIDTH, parts * WIDTH, AT_ONCE, pa.schema

    def costs(column: pa.Array) -> np.ndarray:
        """(rows, components, starts)."""
        flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
        return flat.reshape(-1, parts, width)

    def packed(x: np.ndarray, some: np.ndarray | None = None) -> pa.Array:
        x = np.ascontiguousarray(x)
        whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size * 8), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
        return whole if some is None else pc.if_else(pa.array(some), whole, pa.scalar(None, pa.binary()))

    def groups(nodes: pa.Array, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order that lays rows of the same node and block side by side, and where each group begins."""
        codes = nodes.dictionary_encode().indices.to_numpy()
        order = np.lexsort((blocks, codes))
        c, b = codes[order], blocks[order]
        return order, np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (b[1:] != b[:-1])]))

    def least(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The least cost of each group and start, compared component by component."""
        out = np.empty((len(begins), parts, width))
        open_ = None
        for k in range(parts):
            own = x[:, k] if open_ is None else np.where(open_, x[:, k], np.inf)
            out[:, k] = np.minimum.reduceat(own, begins, axis=0)
            if k + 1 < parts:
                tied = own == np.repeat(out[:, k], np.diff(begins, append=len(x)), axis=0)
                open_ = tied if open_ is None else open_ & tied
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, cost, out -> node, block, cost: the costs by way of each edge, the least of a bounded number of rows at a time."""
        for batch in batches:
            out = batch.column(2)
            ends = np.cumsum(out.value_lengths().to_numpy())
            low = 0
            while low < len(ends):
                done = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + at_once // size, side="right")))
                part = batch.slice(low, high - low)
                edges, blocks, own = part.column(2).flatten(), part.column(0).to_numpy(), costs(part.column(1))
                at = np.repeat(np.arange(high - low), part.column(2).value_lengths().to_numpy())
                low = high
                if not len(at):
                    continue
                nodes, blocks = edges.field(0), blocks[at]
                order, begins = groups(nodes, blocks)
                steps = np.stack([edges.field(1 + k).to_numpy() for k in range(parts)], axis=1)[order]
                found = least(own[at[order]] + steps[:, :, None], begins)
                first = order[begins]
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(first)), pa.array(blocks[first]), packed(found)], ["node", "block", "cost"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, block, old, cost, sorted by node and block -> node, block, cost, front: the least of each group, and of it what is less than the old one."""

        def merged(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            nodes, blocks, old, x = (pa.concat_arrays(rows.column(k).chunks) for k in range(4))
            blocks, old, x = blocks.to_numpy(), old.to_numpy(zero_copy_only=False), costs(x)
            order, begins = groups(nodes, blocks)
            x, old = x[order], old[order]
            now = least(x, begins)
            before = np.full(now.shape, np.inf)
            before[np.searchsorted(begins, np.flatnonzero(old), side="right") - 1] = x[old]
            first = order[begins]
            return nodes.take(pa.array(first)), blocks[first], now, before

        def told(nodes: pa.Array, blocks: np.ndarray, now: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
            # The least is the old cost or less, so it fell where any component differs.
            fell = (now != before).any(axis=1)
            front = np.where(fell[:, None, :], now, np.inf)
            return pa.RecordBatch.from_arrays([nodes, pa.array(blocks), packed(now), packed(front, fell.any(axis=1))], ["node", "block", "cost", "front"])

        held = None  # the last group's rows so far: more of them may come
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            nodes, blocks, now, before = merged(rows)
            if len(blocks) > 1:
                yield told(nodes.slice(0, len(blocks) - 1), blocks[:-1], now[:-1], before[:-1])
            was = np.isfinite(before[-1]).any()
            kept_ = np.stack([before[-1], now[-1]]) if was else now[-1:]
            flags = [True, False] if was else [False]
            last = pa.array([len(blocks) - 1] * len(flags))
            held = pa.Table.from_arrays([nodes.take(last), pa.array(blocks).take(last), pa.array(flags), packed(kept_)], schema=schema_of(batch.schema))
        if held is not None:
            yield told(*merged(held))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, block, cost -> place, node and a column for each component: a row for each start that reaches the node."""
        for batch in batches:
            x = costs(batch.column(2)) if batch.num_rows else np.empty((0, parts, width))
            row, slot = np.nonzero(np.isfinite(x[:, 0]))
            place = batch.column(1).to_numpy()[row] * width + slot
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), batch.column(0).take(pa.array(row)), *[pa.array(x[row, k, slot]) for k in range(parts)]], ["place", "node", *[f"c{k}" for k in range(parts)]])

    return send, merge, flat


def _fallen(now: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where found (components first) is less than now, compared component by component."""
    fell = found[-1] < now[-1]
    for k in range(len(now) - 2, -1, -1):
        fell = (found[k] < now[k]) | ((found[k] == now[k]) & fell)
    return fell


def _whole(edges: pa.Table, starts: pa.Table) -> pa.Table:
    """Of a lot's edges (lot, block, src, dst and a column for each component) and the starts (lot, block, id) of a block: start, node and a column for each component."""
    names = edges.column_names[4:]
    ids, (src, dst, at) = coded(edges.column("src"), edges.column("dst"), starts.column("id"))
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    steps = np.stack([edges.column(n).to_numpy()[order] for n in names])
    n, width, parts = len(ids), len(at), len(names)
    now = np.full((parts, n, width), np.inf)
    now[:, at, np.arange(width)] = 0.0
    flat = now.reshape(parts, n * width)
    changed = np.zeros(n, bool)
    changed[at] = True
    while changed.any():
        some = np.flatnonzero(changed[src])
        changed = np.zeros(n, bool)
        heads = dst[some]
        begins = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(some) else np.empty(0, np.int64)
        # Nodes with all of their edges, a bounded number of edges at a time; what has fallen already goes on in the same round.
        low, most = 0, max(1, CELLS // width)
        while low < len(begins):
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + most, side="right")) - 1) if begins[-1] > begins[low] + most else len(begins)
            first, last = begins[low], begins[high] if high < len(begins) else len(some)
            own, to = begins[low:high] - first, heads[begins[low:high]]
            e = some[first:last]
            x = now[0, src[e]] + steps[0, e, None]
            least = np.minimum.reduceat(x, own, axis=0)
            if parts == 1:
                old = now[0, to]
                fell = least < old
                now[0, to] = np.minimum(least, old)
                changed[to[fell.any(axis=1)]] = True
            else:
                # Only what ties the least first component, and doesn't exceed the cost so far, is compared further.
                bar = np.where(least <= now[0, to], least, -1.0)
                row, slot = np.nonzero(x == np.repeat(bar, np.diff(own, append=len(e)), axis=0))
                row, slot = row[np.isfinite(x[row, slot])], slot[np.isfinite(x[row, slot])]
                cells = heads[first:last][row] * width + slot
                tried = [x[row, slot], *[now[k, src[e[row]], slot] + steps[k, e[row]] for k in range(1, parts)]]
                order = np.lexsort([*tried[:0:-1], cells])
                ahead = order[np.concatenate([[True], cells[order[1:]] != cells[order[:-1]]])] if len(order) else order
                cells, tried = cells[ahead], np.stack([t[ahead] for t in tried])
                fell = _fallen(flat[:, cells], tried)
                flat[:, cells[fell]] = tried[:, fell]
                changed[cells[fell] // width] = True
            low = high
    node, slot = np.nonzero(np.isfinite(now[0]))
    return pa.Table.from_arrays([ids.take(pa.array(at[slot])), ids.take(pa.array(node)), *[pa.array(x[node, slot]) for x in now]], ["start", "node", *names])


def cheapest(e: DataFrame, starts: DataFrame, cost: Sequence[Column], most: int = 200) -> DataFrame:
    """(start, node, cost): least total cost; costs are finite numbers >= 0, compared one after the other.

    Edges with a null end or cost and null starts are left out. Components too large for a task are relaxed in rounds, `most` at most.
    """
    names = [f"c{k}" for k in range(len(cost))]
    e = kept(e.select("src", "dst", *[c.cast("double").alias(n) for n, c in zip(names, cost)]).dropna().repartitionByRange("src"), "cost-edges")
    kind = e.schema["src"].dataType
    starts = kept(starts.select(F.col("id").cast(kind).alias("id")).dropna().distinct(), "cost-starts")
    of = lots(e, starts)
    inner, at = dealt(e, starts, of, CELLS, WIDTH)
    schema = f"start {kind.simpleString()}, node {kind.simpleString()}, {', '.join(n + ' double' for n in names)}"
    found = inner.groupBy("lot", "block").cogroup(at.groupBy("lot", "block")).applyInArrow(_whole, schema).select("start", "node", F.struct(*names).alias("cost"))
    beyond = rest(e, starts, of)
    return found if beyond is None else found.unionByName(by_rounds(*beyond, [F.col(n) for n in names], most))


def by_rounds(e: DataFrame, starts: DataFrame, cost: Sequence[Column], most: int = 200) -> DataFrame:
    """(start, node, cost): least total cost by relaxation rounds, until one changes nothing; costs are finite numbers >= 0, compared one after the other.

    Edges with a null end or cost and null starts are left out.
    """
    names = [f"c{k}" for k in range(len(cost))]
    send, merge, flat = _steps(len(cost))
    e = e.select("src", "dst", *[c.cast("double").alias(n) for n, c in zip(names, cost)]).dropna()
    chunk = F.floor((F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1) / EDGES)
    out = kept(e.withColumn("chunk", chunk).groupBy("src", "chunk").agg(F.collect_list(F.struct("dst", *names)).alias("out")).select("src", "out"), "cost-edges")
    node = f"node {out.schema['src'].dataType.simpleString()}"
    # Numbers that ascend with the starts, so that neighbours share a row.
    places = kept(starts.select(F.col("id").cast(out.schema["src"].dataType).alias("start")).dropna().distinct().orderBy("start").withColumn("place", F.monotonically_increasing_id()), "cost-starts")
    block, slot = F.expr(f"place div {WIDTH}").alias("block"), F.pmod("place", F.lit(WIDTH))

    def first(batches: Iterator[pa.RecordBatch], width: int = WIDTH, parts: int = len(cost)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.full((batch.num_rows, parts, width), np.inf)
            x[np.arange(batch.num_rows), :, batch.column(2).to_numpy()] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "block", "front"])

    now = kept(places.select(F.col("start").alias("node"), block, slot.alias("slot")).mapInArrow(first, f"{node}, block long, front binary"), "costs")
    now = now.withColumn("cost", F.col("front"))
    for _ in range(most):
        front = now.filter("front IS NOT NULL").select("node", "block", F.col("front").alias("cost"))
        sent = front.join(out, F.col("node") == F.col("src")).select("block", "cost", "out").mapInArrow(send, f"{node}, block long, cost binary")
        rows = now.select("node", "block", F.lit(True).alias("old"), "cost").unionByName(sent.select("node", "block", F.lit(False).alias("old"), "cost"))
        now = kept(rows.repartition("node").sortWithinPartitions("node", "block").mapInArrow(merge, f"{node}, block long, cost binary, front binary"), "costs")
        if not now.filter("front IS NOT NULL").head(1):
            found = now.select("node", "block", "cost").mapInArrow(flat, f"place long, {node}, {', '.join(n + ' double' for n in names)}")
            return found.join(places, "place").select("start", "node", F.struct(*names).alias("cost"))
    raise RuntimeError(f"costs still fall after {most} rounds")
