"""Hard-negative mining: scores bounded along a spanning tree of the anchors.

Anchors are dealt to blocks of near ones, and each block gets the minimum spanning tree of its distances.  If ``p`` is an anchor's parent, then
for every row ``x`` the anchor's score lies within ``|a - p| |x|`` of the parent's, so a row is scored again only if that range meets the scores
the anchor still looks for.  A row that isn't scored passes its range on, wider by each edge.

Blocks of anchors meet parts of the rows in groups of a bounded size, which keep a few rows an anchor; no row is left out by any other rule than
the bound, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ranges
from .shared import stash

#: Anchors of a block, components of a part of the rows, least parts, and rows scored at once.
BLOCK, PART_SIZE, PARTS, AT_ONCE = 2048, 1 << 22, 32, 1024
SCALE = 256.0
#: Sums of products up to here, a hundred times over, are exact in doubles.
EXACT = 2.0**53 / 128
_FOUND = "anchor_id long, slot int, id long, score long"


def usable(rows: DataFrame) -> DataFrame:
    """``id, label, vector`` without rows that have a null or a component that isn't finite; of the rows of one id the least by label and vector."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    return whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select(F.col("id").cast("long").alias("id"), F.col("r.label").cast("long").alias("label"), "r.vector")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of floor(256 x); shorter ones end in zeros."""
    column = column.combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    import pyarrow.compute as pc

    return max([0, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns)])


def _tree(block: pa.Table) -> pa.Table:
    """The block's anchors in an order in which each follows its parent, with the parent's place and distance; -1 for the first."""
    a = _matrix(block["vector"], _width(block["vector"]))
    n = len(a)
    near, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    place, order, parents, far = np.zeros(n, int), [], [], []
    now = int(np.argmin(block["id"].to_numpy()))
    for k in range(n):
        place[now], left[now] = k, False
        order.append(now)
        parents.append(-1 if k == 0 else int(place[parent[now]]))
        far.append(0.0 if k == 0 else float(near[now]))
        gap = np.sqrt(((a - a[now]) ** 2).sum(1))
        closer = left & (gap < near)
        near[closer], parent[closer] = gap[closer], now
        if k + 1 < n:
            now = int(np.argmin(np.where(left, near, np.inf)))
            now = now if left[now] else int(np.flatnonzero(left)[0])  # distances beyond all doubles
            parent[now] = parent[now] if parent[now] >= 0 else order[0]
    out = block.take(pa.array(order))
    return out.append_column("place", pa.array(range(n), pa.int32())).append_column("parent", pa.array(parents, pa.int32())).append_column("far", pa.array(far, pa.float64()))


def anchor_trees(anchors: DataFrame) -> DataFrame:
    """``block, id, label, vector, place, parent, far`` of anchors: blocks of at most ``BLOCK`` by label and the first signs of the vector."""
    signs = F.aggregate(F.slice("vector", 1, 16), F.lit(0), lambda s, x: s * 2 + (x > 0).cast("int"))
    kept = anchors.select("id", "label", "vector", signs.alias("signs"))
    dealt = ranges.numbered(kept, [], [F.col("label"), F.col("signs"), F.col("id")], "k").select(F.floor((F.col("k") - 1) / BLOCK).cast("int").alias("block"), "id", "label", "vector")
    kind = anchors.schema["vector"].dataType.simpleString()
    return stash(dealt.groupBy("block").applyInArrow(_tree, f"block int, id long, label long, vector {kind}, place int, parent int, far double"), "anchor-trees")


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best scores, ties by the smaller id."""
    if len(score) > 4 * n:
        fine = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        return fine[np.lexsort((ids[fine], -score[fine]))][:n]
    return np.lexsort((ids, -score))[:n]


def _whole(m: np.ndarray) -> np.ndarray:
    """The same numbers as Python's whole numbers, which have no bound."""
    out = np.empty(m.shape, object)
    out[...] = [[int(x) for x in row] for row in m.tolist()] if m.size else out
    return out


def _search(n: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Best ``n`` rows of a part for every anchor of a block and every one of its windows ``low <= 100 score <= high``."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: dict[str, list] = {"anchor_id": [], "slot": [], "id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            anchors = anchors.sort_by("place")
            width = _width(anchors["vector"], rows["vector"])
            a, a_ids, a_labels = _matrix(anchors["vector"], width), anchors["id"].to_numpy(), anchors["label"].to_numpy()
            parent, far = anchors["parent"].to_numpy(), anchors["far"].to_numpy()
            slots = [[(k, lo, hi) for k, (lo, hi) in enumerate(w) if lo <= hi] for w in zip_windows(anchors)]
            x, ids, labels = _matrix(rows["vector"], width), rows["id"].to_numpy(), rows["label"].to_numpy()
            exact = width * np.abs(a).max(initial=0) * np.abs(x).max(initial=0) < EXACT
            if not exact:
                a, x = _whole(a), _whole(x)
            none = (x[:0] @ a[0] if width else np.zeros(0), ids[:0])
            best = {(i, k): none for i, s in enumerate(slots) for k, _, _ in s}
            for first in range(0, len(ids), AT_ONCE):
                part, part_ids, part_labels = x[first : first + AT_ONCE], ids[first : first + AT_ONCE], labels[first : first + AT_ONCE]
                size = np.sqrt((part * part).sum(1)) if exact else None
                least, most = np.zeros((2, len(a), len(part_ids)))
                for i in range(len(a)):
                    if exact:
                        slack = 0 if i == 0 else far[i] * size * (1 + 1e-9) + 1e-3
                        least[i] = least[parent[i]] - slack if i else -np.inf
                        most[i] = most[parent[i]] + slack if i else np.inf
                    if not slots[i] and (i or not exact):
                        continue
                    want = (part_labels == a_labels[i]) == same
                    want &= part_ids != a_ids[i]
                    if exact and slots[i]:
                        low = min(max(lo / 100, best[i, k][0][-1] if len(best[i, k][0]) == n else -np.inf) for k, lo, _ in slots[i])
                        want &= (most[i] >= low - 1e-6) & (least[i] <= max(hi for _, _, hi in slots[i]) / 100 + 1e-6)
                    scored = want if i or not exact else np.ones_like(want)  # the first anchor's scores bound all others
                    at = np.flatnonzero(scored)
                    if not len(at):
                        continue
                    score = part[at] @ a[i] if width else np.zeros(len(at))
                    if exact:
                        least[i, at] = most[i, at] = score
                    here, score = at[want[at]], score[want[at]]
                    for k, lo, hi in slots[i]:
                        fit = np.flatnonzero((100 * score >= lo) & (100 * score <= hi))
                        if len(fit):
                            s, t = np.concatenate([best[i, k][0], score[fit]]), np.concatenate([best[i, k][1], part_ids[here[fit]]])
                            top = _best(s, t, n)
                            best[i, k] = s[top], t[top]
            for (i, k), (score, own) in best.items():
                found["anchor_id"] += [int(a_ids[i])] * len(own)
                found["slot"] += [k] * len(own)
                found["id"] += own.tolist()
                found["score"] += [max(-(2**63), min(2**63 - 1, int(s))) for s in score.tolist()]
        return pa.table(found, pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]))

    def zip_windows(anchors: pa.Table) -> list[list[tuple[float, float]]]:
        if same:
            return [[(-np.inf, np.inf)]] * anchors.num_rows
        return [list(zip(lo or [], hi or [])) for lo, hi in zip(anchors["low"].to_pylist(), anchors["high"].to_pylist())]

    return run


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has id (whole numbers), label (whole numbers) and vector; ``is_anchor`` is a condition on id.  An anchor's positives are its best
    other rows of its label, and a positive's negatives the best rows of other labels with ``low`` to ``high`` per cent of the positive's score;
    a positive with a negative score has none.  Scores are whole: inner products of floor(256 x).  Rows with nulls or components that aren't
    finite take no part, rows of one id count once, vectors that are shorter than others end in zeros, and ties go to the smaller id.  Scores
    beyond a long are its bound.  Other columns are ignored; an empty table, or one without anchors, gives no rows.
    """
    held = stash(usable(rows), "vectors")
    tree = anchor_trees(held.where(is_anchor))
    sizes = held.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()
    blocks = tree.agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("n")).first().n
    parts = max(PARTS, -(-sizes.n // PART_SIZE))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = held.select("*", each(max(1, blocks)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))

    def searched(anchors: DataFrame, n: int, same: bool) -> DataFrame:
        asked = anchors.select("*", each(parts).alias("part"))
        return asked.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(_search(n, same), _FOUND)

    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    near = searched(tree, positives, True).withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives)
    near = stash(near.select("anchor_id", (F.col("k") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    ordered = near.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    bound = lambda share: F.transform("p", lambda p: p["positive_score"].cast("double") * share)
    windows = tree.join(ordered, "id").select("block", "id", "label", "vector", "place", "parent", "far", bound(low).alias("low"), bound(high).alias("high"))
    # every anchor stays in the tree, without a window if it has no positive
    windows = windows.unionByName(tree.join(ordered, "id", "left_anti"), allowMissingColumns=True)
    hard = searched(windows, negatives, False).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return hard.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
