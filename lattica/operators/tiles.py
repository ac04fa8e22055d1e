"""Greedy choices among boxes, settled tile by tile. What a choice depends on lies near it, so a task that sees a tile and a margin around it can tell most choices inside
for certain; what it can't tell stays open. Pairs are neither shuffled nor saved; each box is, in the tiles that see it."""

from __future__ import annotations

import heapq
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that a tile has about.
TILE = 20_000
#: A tile's margin, as a share of its side.
MARGIN = 1 / 6
#: How much wider tiles may be than for so many boxes, and how many times as wide as doubt goes in a random walk.
FULLER, CHAINS = 4, 3.2


def side_for(boxes: DataFrame, reach: float, per_tile: int, chains: bool = False) -> float | None:
    """The side of tiles that hold about `per_tile` boxes where most boxes lie, if their margins hold what the largest box reaches; None if there are no boxes, or if tiles for that
    would be far fuller. chains: doubt goes from box to box, about as often as a box has others to choose from and each time some way, so where boxes lie densely tiles are wider than that, if they
    are not far fuller for it."""
    longer = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    of = boxes.agg(F.avg(longer).alias("mean"), F.max(longer).alias("most")).first()
    if of.mean is None or not 0 < of.mean + reach < 1e100:
        return None
    step = of.mean + reach
    cells = boxes.groupBy("page", F.floor(F.col("x0") / step), F.floor(F.col("y0") / step)).agg(F.count("*").cast("double").alias("n"))
    crowd = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    dense = step * (per_tile / crowd) ** 0.5
    need = 1.1 * (of.most + reach) / MARGIN
    wide = CHAINS * of.mean * (crowd * 2) ** 0.5 * of.mean / step if chains else 0.0
    return max(dense, need, min(wide, FULLER * dense)) if need <= FULLER * dense else None


def dealt(boxes: DataFrame, side: float, shift: float, reach: float) -> DataFrame:
    """boxes, a row for each tile (tx, ty) that sees them; own: whether they begin in the tile; whole: whether all that they reach is seen as well."""
    margin, own, whole = side * MARGIN, F.lit(True), F.lit(True)
    for d in "xy":
        at = lambda c, by: F.floor((F.col(f"{d}{c}") + F.lit(by - shift)) / F.lit(side))  # noqa: B023, E731
        boxes = boxes.withColumn(f"t{d}", F.explode(F.sequence(at(0, -margin), at(1, margin))))
        start = F.col(f"t{d}") * F.lit(side) + F.lit(shift)
        own &= at(0, 0.0) == F.col(f"t{d}")
        slack = reach + side * 1e-6
        whole &= (F.col(f"{d}0") - slack > start - margin) & (F.col(f"{d}1") + slack < start + side + margin)
    return boxes.withColumn("own", own).withColumn("whole", whole)


def by_tile(dealt: DataFrame, settle, kind, n: int, per_tile: int) -> DataFrame:
    """What a function makes of each tile; n: how many boxes were dealt. A tile is more work than its size tells, so tasks are small."""
    at = ["page", "tx", "ty"]
    return dealt.repartition(max(8, min(4000, 4 * n // per_tile)), *at).groupBy(*at).applyInPandas(settle, kind)


def assigned(pdf: pd.DataFrame, reach: float) -> pd.DataFrame:
    """a_id, b_id, distance2 of the pairs that are taken whatever lies outside, and of left boxes (right: false) that surely find none, with nulls, where the left box is the tile's own.
    Pairs come by distance, then ids. A box that may be taken from outside, or that may have been taken before, is in doubt. If one of a pair is in doubt and the other is free, the
    first is gone after that pair in any case and the other is in doubt; a pair of two in doubt changes nothing, so a left box in doubt looks at free ones only. All that touch are
    equally near, so left boxes take those in turn before any looks further."""
    a, b = (pdf[pdf["right"] == side].sort_values("id", kind="stable") for side in (False, True))
    box_a, box_b = ([p[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1")] for p in (a, b))
    # 0: free, 1: in doubt, 2: gone
    of_a, of_b = ((~(p["whole"] & p["single"]).to_numpy(bool)).astype(int).tolist() for p in (a, b))
    step = max((float((box[k + 2] - box[k]).max()) for box in (box_a, box_b) if len(box[0]) for k in (0, 1)), default=0.0) or reach or 1.0
    # some more, for what rounding does to differences
    step *= 1 + 1e-9
    cells = {(int(x), int(y)): here for (x, y), here in pd.DataFrame({"x": box_b[0] // step, "y": box_b[1] // step}).groupby(["x", "y"]).indices.items()}
    of_cells = lambda x0, y0, x1, y1: [(cx, cy) for cx in range(int(x0 // step) - 1, int(x1 // step) + 1) for cy in range(int(y0 // step) - 1, int(y1 // step) + 1)]
    rects, none = list(zip(*(c.tolist() for c in box_b), strict=True)), len(b)
    # the first ones last, where they leave when they are gone
    lists = [{at: [j for j in here[::-1].tolist() if of_b[j] == state] for at, here in cells.items()} for state in (0, 1)]

    def first(at: list[tuple[int, int]], x0: float, y0: float, x1: float, y1: float, state: int, best: int) -> int:
        """The first right box in a state that touches, or `best`, if that is before it."""
        for cell in filter(None, map(lists[state].get, at)):
            while cell and of_b[cell[-1]] != state:
                cell.pop()
            for j in reversed(cell):
                if j >= best:
                    break
                if of_b[j] == state:
                    p0, q0, p1, q1 = rects[j]
                    if p0 <= x1 and x0 <= p1 and q0 <= y1 and y0 <= q1:
                        best = j
                        break
        return best

    out, rest = [], []
    for i, box in enumerate(zip(*(c.tolist() for c in box_a), strict=True)):
        at = of_cells(*box)
        j = first(at, *box, 0, none)
        if not of_a[i] and (k := first(at, *box, 1, j)) < j:
            of_a[i], of_b[k] = 1, 2
        if j == none:
            rest.append(i)
        elif of_a[i]:
            of_a[i], of_b[j] = 2, 1
            insort(lists[1][int(rects[j][0] // step), int(rects[j][1] // step)], j, key=lambda k: -k)
        else:
            of_a[i] = of_b[j] = 2
            out.append((i, j, 0.0))
    of_b = np.array(of_b, np.int8)

    def further(i: int, after: tuple[float, int]) -> list[tuple[float, int] | None]:
        """The nearest right boxes within reach that are not gone, behind the last one: some, and None if there are more."""
        x0, y0, x1, y1 = (c[i] for c in box_a)
        near = []
        for at in of_cells(x0 - reach, y0 - reach, x1 + reach, y1 + reach):
            if at in cells:
                left = of_b[cells[at]] < 2
                if not left.all():
                    cells[at] = cells[at][left]
                near.append(cells[at])
        if not near:
            return []
        near = np.concatenate(near)
        if of_a[i]:
            near = near[of_b[near] == 0]
        p0, q0, p1, q1 = (c[near] for c in box_b)
        dx, dy = np.maximum(0.0, np.maximum(x0 - p1, p0 - x1)), np.maximum(0.0, np.maximum(y0 - q1, q0 - y1))
        d = dx * dx + dy * dy
        fine = (d <= reach * reach) & ((d > after[0]) | ((d == after[0]) & (near > after[1])))
        near, d = near[fine], d[fine]
        some = np.lexsort((near, d))[:12]
        found = list(zip(d[some].tolist(), near[some].tolist(), strict=True))
        return [*found, None] if len(near) > len(found) else found

    queue, ahead = [(0.0, i, none, 0) for i in rest], {}
    while queue:
        d, i, j, k = heapq.heappop(queue)
        if j == none:
            ahead[i] = further(i, (0.0, none))
        elif of_b[j] < 2:
            if not of_a[i] and not of_b[j]:
                out.append((i, j, d))
                of_a[i] = of_b[j] = 2
            elif not of_a[i]:
                of_a[i], of_b[j] = 1, 2
            elif not of_b[j]:
                of_a[i], of_b[j] = 2, 1
            if of_a[i] == 2:
                ahead.pop(i)
                continue
        while k < len(ahead[i]):
            if ahead[i][k] is None:
                ahead[i], k = further(i, ahead[i][k - 1]), 0
            elif of_b[ahead[i][k][1]] > 1 - of_a[i]:
                k += 1
            else:
                heapq.heappush(queue, (ahead[i][k][0], i, ahead[i][k][1], k + 1))
                break
        else:
            ahead.pop(i)
    own, ids_a, ids_b = a["own"].to_numpy(bool), a["id"].to_numpy(), b["id"].to_numpy()
    taken = [(ids_a[i], ids_b[j], d) for i, j, d in out if own[i]]
    alone = [(i, None, None) for i in ids_a[own & (np.array(of_a, int) == 0)]]
    return pd.DataFrame({"a_id": [t[0] for t in taken + alone], "b_id": pd.array([t[1] for t in taken + alone], dtype="object"), "distance2": pd.array([t[2] for t in taken + alone], dtype="Float64")})


def suppressed(pdf: pd.DataFrame, threshold: float, inside: float | None) -> pd.DataFrame:
    """The tile's own boxes and `kept`: whether a box stays, whatever lies outside; null where that is in doubt. Boxes come by rank_kind, rank_score and id; one that collides
    with a better one that stays is lost, else one that collides with a better one in doubt is in doubt itself, as is one whose surroundings are not all seen. Along the tile's rim very many are
    in doubt, so what is in doubt in any case does not look at them, and others look until they find one."""
    pdf = pdf.sort_values(["rank_kind", "rank_score", "id"], kind="stable")
    boxes = list(zip(*[pdf[c].tolist() for c in ("x0", "y0", "x1", "y1")], strict=True))
    step = max((max(x1 - x0, y1 - y0) for x0, y0, x1, y1 in boxes), default=0.0) or 1.0
    if inside is None and 0 < threshold < 1:
        # boxes share no more along an axis than the shorter side there, so those that share that much of both begin nearer to each other
        step *= 1 - threshold
    # some more, for what rounding does to differences
    step *= 1 + 1e-9
    cells = [(k, j) for k in (0.0, -1.0, 1.0) for j in (0.0, -1.0, 1.0)]

    def collides(near: list[list], x0: float, y0: float, x1: float, y1: float, area: float) -> bool:
        for cell in near:
            for p0, q0, p1, q1, other in cell:
                if p0 > x1 or p1 < x0 or q0 > y1 or q1 < y0:
                    continue
                shared = ((x1 if x1 < p1 else p1) - (x0 if x0 > p0 else p0)) * ((y1 if y1 < q1 else q1) - (y0 if y0 > q0 else q0))
                both = area + other - shared
                if (shared / both if both > 0 else 0.0) >= threshold or (inside is not None and min(area, other) > 0 and shared / min(area, other) >= inside):
                    return True
        return False

    stay: dict[tuple[float, float], list] = {}
    unsure: dict[tuple[float, float], list] = {}
    kept: list[bool | None] = []
    for box, whole in zip(boxes, pdf["whole"].tolist(), strict=True):
        x0, y0, x1, y1 = box
        area, cx, cy = (x1 - x0) * (y1 - y0), x0 // step, y0 // step
        at = [(cx + k, cy + j) for k, j in cells]
        lost = collides([stay[c] for c in at if c in stay], *box, area)
        doubt = not lost and (not whole or collides([unsure[c] for c in at if c in unsure], *box, area))
        if not lost:
            (unsure if doubt else stay).setdefault((cx, cy), []).append((*box, area))
        kept.append(False if lost else None if doubt else True)
    return pdf.assign(kept=pd.array(kept, dtype="boolean"))[pdf["own"].to_numpy(bool)]
