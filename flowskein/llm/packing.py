"""Documents into context windows of fixed capacity.

Documents are hashed to cells of a few thousand windows; each cell is packed on
its own by the linear grouping scheme. Large lengths are rounded up within
groups of equal cardinality, a linear programme over window configurations
(column generation, a knapsack as pricing) is solved for those few sizes, its
windows are filled with actual documents, and small documents are put best-fit
into the room that is left. A document is cut only if it exceeds the capacity.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein.session import task_count

#: Expected windows and items of a cell: what one task packs at a time.
CELL_WINDOWS, CELL_ITEMS = 2_000, 40_000
#: Repeats of one row that are numbered at a time.
COPIES = 65_536
#: Items above this share of the capacity are large; groups of large items.
LARGE, GROUPS = 1 / 8, 24


def byte_tokens(text: Column) -> Column:
    """Tokens of the public ByT5 tokenizer: one for each UTF-8 byte, no end mark; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _best_pattern(sizes: np.ndarray, gain: np.ndarray, capacity: int) -> np.ndarray:
    """Pricing: the multiset of sizes that fits and gains most."""
    most = int(capacity // sizes.min())
    best = np.zeros(capacity + 1)
    picks: list[np.ndarray] = []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for k, size in enumerate(sizes):
            value = best[: capacity + 1 - size] + gain[k]
            better = value > new[size:] + 1e-12
            new[size:][better] = value[better]
            pick[size:][better] = k
        picks.append(pick)
        if (pick < 0).all():
            break
        best = new
    pattern = np.zeros(len(sizes))
    room = capacity
    for pick in reversed(picks):
        if (k := pick[room]) >= 0:
            pattern[k] += 1
            room -= int(sizes[k])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Window configurations and how often to use each, rounded down from the optimum.

    The optimum of the linear programme: least windows that hold ``demand`` items
    of each size. Sizes are distinct, positive and fit.
    """
    n = len(sizes)
    basis = np.diag(np.floor(capacity / sizes).astype(float))
    level = demand / np.diag(basis)
    for _ in range(20 * n):
        gain = np.linalg.solve(basis.T, np.ones(n))
        pattern = _best_pattern(sizes, gain, capacity)
        if gain @ pattern <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        level = level - ratio[out] * step
        level[out] = ratio[out]
        basis[:, out] = pattern
    return [(np.rint(basis[:, j]).astype(int), int(math.floor(level[j] + 1e-9))) for j in range(n) if level[j] >= 1 - 1e-9]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each item; every size is at most ``capacity``."""
    window = np.full(len(sizes), -1, dtype=np.int64)
    room: list[int] = []
    large = np.flatnonzero(sizes > capacity * LARGE)
    large = large[np.argsort(-sizes[large], kind="stable")]
    if len(large):
        groups = np.array_split(large, min(GROUPS, len(large)))
        by_size: dict[int, list[int]] = {}
        for group in groups:  # descending: the first of a group is its largest
            by_size.setdefault(int(sizes[group[0]]), []).extend(group.tolist())
        rounded = np.array(list(by_size))
        queues = [by_size[s] for s in rounded.tolist()]
        for pattern, times in configurations(rounded, np.array([len(q) for q in queues], dtype=float), capacity):
            for _ in range(times):
                members = [queues[k].pop() for k, c in enumerate(pattern) for _ in range(min(c, len(queues[k])))]
                if members:
                    window[members] = len(room)
                    room.append(capacity - int(sizes[members].sum()))
    # best-fit, longest first, for what the rounded solution left over and for the small
    left = np.flatnonzero(window < 0)
    left = left[np.argsort(-sizes[left], kind="stable")]
    at: dict[int, list[int]] = {}
    for w, r in enumerate(room):
        at.setdefault(r, []).append(w)
    rooms = sorted(at)
    for item in left.tolist():
        size = int(sizes[item])
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            r = rooms[k]
            w = at[r].pop()
            if not at[r]:
                del at[r]
                rooms.pop(k)
        else:
            r, w = capacity, len(room)
            room.append(capacity)
        window[item] = w
        r -= size
        if r in at:
            at[r].append(w)
        else:
            at[r] = [w]
            bisect.insort(rooms, r)
    return window


def windows(documents: DataFrame, capacity: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A place for every document: ``doc_id``, ``piece``, ``n_pieces``, ``window_id``, ``start``, ``n_tokens``.

    Pieces count from 0; all but the last of a cut document fill a window of
    their own. ``start`` is the first token's place in the window. A null or
    empty text takes no room but has a place. Every row is a document, repeated
    or null keys too. Only keys and lengths are shuffled; cells are hashed by
    key (by text where the key is null) and number among repeats, so neither
    copies nor repeated rows fill one.
    """
    sized = documents.select(F.col(key).alias("doc_id"), byte_tokens(F.col(text)).alias("size"), F.when(F.col(key).isNull(), F.xxhash64(text)).alias("own"))
    total = sized.agg(F.sum("size"), F.count("*")).first()
    cells = max(1, math.ceil((total[0] or 0) / (capacity * CELL_WINDOWS)), math.ceil(total[1] / CELL_ITEMS))

    def fill(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "doc_id"], kind="stable")
        size = cell["size"].to_numpy(np.int64)
        full = np.where(size > capacity, (size - 1) // capacity, 0)  # windows that one document fills
        rest = size - full * capacity
        window = pack(rest, capacity)
        order = np.lexsort((np.arange(len(rest)), window))
        before = np.cumsum(rest[order]) - rest[order]
        opened = np.r_[True, np.diff(window[order]) > 0] if len(order) else np.zeros(0, bool)
        base = before[np.maximum.accumulate(np.where(opened, np.arange(len(order)), 0))] if len(order) else before
        start = np.empty(len(rest), dtype=np.int64)
        start[order] = before - base
        # the last pieces, then the pieces that fill a window
        rows = np.repeat(np.arange(len(size)), full)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        first = int(window.max()) + 1 if len(window) else 0
        at = np.r_[np.arange(len(size)), rows]
        number = np.r_[window, first + np.arange(len(rows))]
        return pd.DataFrame({
            "doc_id": cell["doc_id"].to_numpy()[at],
            "piece": np.r_[full, piece].astype(np.int32),
            "n_pieces": (full[at] + 1).astype(np.int32),
            "window_id": (int(cell["cell"].iat[0]) << 32) + number,
            "start": np.r_[start, np.zeros(len(rows), np.int64)].astype(np.int32),
            "n_tokens": np.r_[rest, np.full(len(rows), capacity)].astype(np.int32),
        })

    kind = dict(sized.dtypes)["doc_id"]
    # repeated rows are counted, numbered and spread, a block of numbers at a time
    alike = sized.groupBy("doc_id", "size", "own").agg(F.count("*").alias("n"))
    blocks = alike.withColumn("b", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    copies = blocks.withColumn("c", F.explode(F.expr(f"sequence(b * {COPIES}, least(n, (b + 1) * {COPIES}) - 1)")))
    placed = copies.select("doc_id", "size", F.pmod(F.xxhash64("doc_id", "size", "own", "c"), F.lit(cells)).cast("int").alias("cell"))
    # a number of its own keeps cells apart that are small to shuffle and long to pack
    return placed.repartition(min(cells, task_count(documents.sparkSession)), "cell").groupBy("cell").applyInPandas(
        fill, f"doc_id {kind}, piece int, n_pieces int, window_id bigint, start int, n_tokens int"
    )


def fill_report(placed: DataFrame, capacity: int = 4096) -> DataFrame:
    """Windows, tokens, the share of room used, and documents that were cut."""
    return placed.agg(
        F.countDistinct("window_id").alias("n_windows"),
        F.sum(F.col("n_tokens").cast("bigint")).alias("n_tokens"),
        F.sum((F.col("n_pieces") > 1).cast("bigint") * (F.col("piece") == 0).cast("bigint")).alias("n_cut"),
    ).withColumn("fill", F.col("n_tokens") / (F.col("n_windows") * capacity))


def guarantees(placed: DataFrame, documents: DataFrame, capacity: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row that says whether the windows keep what they promise.

    Documents and tokens placed, documents cut; windows that hold more than
    ``capacity``; windows in which pieces overlap or leave a gap; keys whose
    pieces do not add up to the tokens of their documents. ``tight``: no more
    windows than tokens need, but for one of a hundred and one of each cell.
    """
    each = placed.groupBy("window_id").agg(
        F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.sum(F.col("start").cast("bigint") * F.col("n_tokens")).alias("moment"),
        F.sum(F.col("n_tokens").cast("bigint") * F.col("n_tokens")).alias("squares"),
    )
    # pieces side by side from 0: twice the sum of start * n is the square of all less the squares of each
    over = each.agg(
        F.count("*").alias("n_windows"), F.count_if(F.col("end") > capacity).alias("n_overfull"), F.count_if((F.col("end") != F.col("n")) | (2 * F.col("moment") != F.col("n").cast("bigint") * F.col("n") - F.col("squares"))).alias("n_overlaps"),
        F.countDistinct(F.shiftrightunsigned("window_id", 32)).alias("n_cells"),
    )
    own = placed.groupBy("doc_id").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("n"), F.count_if(F.col("piece") == 0).alias("rows"))
    real = documents.groupBy(F.col(key).alias("doc_id")).agg(F.sum(byte_tokens(F.col(text))).alias("n"), F.count("*").alias("rows"))
    counted = own.withColumn("side", F.lit(1)).unionByName(real.withColumn("side", F.lit(-1))).groupBy("doc_id").agg(F.sum(F.col("n") * F.col("side")).alias("off"), F.sum(F.col("rows") * F.col("side")).alias("off_rows"))
    wrong = counted.agg(F.count_if((F.col("off") != 0) | (F.col("off_rows") != 0)).alias("n_wrong_sizes"))
    totals = placed.agg(
        F.count_if(F.col("piece") == F.col("n_pieces") - 1).alias("n_documents"), F.coalesce(F.sum(F.col("n_tokens").cast("bigint")), F.lit(0)).alias("n_tokens"),
        F.count_if((F.col("n_pieces") > 1) & (F.col("piece") == 0)).alias("n_cut"),
    )
    tight = F.col("n_windows") <= F.ceil(F.col("n_tokens") / capacity * 1.01) + F.col("n_cells")
    one = lambda df: df.withColumn("__one", F.lit(1))
    # three tables of one row each
    return one(totals).join(one(over), "__one").join(one(wrong), "__one").select("n_documents", "n_tokens", "n_cut", "n_overfull", "n_overlaps", "n_wrong_sizes", tight.alias("tight"))
