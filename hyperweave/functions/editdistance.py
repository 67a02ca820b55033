"""Edit distances of two small hypergraphs.

Costs: a fact of arity a is inserted or deleted for a + 1, a constant of degree h is deleted for h + 1 (and inserted
likewise), and a fact that is kept loses or gains members, or changes its label, for one each; a constant's label
changes for one. A map of constants settles all costs, so the exact distance is a best-first search over maps, with
a bound on its expansions; the bipartite one takes the map of an assignment, and is an upper bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Fact = tuple[int, tuple[int, ...]]
Graph = tuple[list[int], list[Fact]]
MAX_STEPS = 20_000


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row in a least-cost assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, way, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[col]:
            used[col] = True
            here, step, to = match[col], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    gap = cost[here - 1][j - 1] - u[here] - v[j]
                    if gap < least[j]:
                        least[j], way[j] = gap, col
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            col = to
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def fact_cost(a: list[Fact], b: list[Fact]) -> float:
    """The cheapest way to turn facts over the same names into others: each kept, deleted or inserted."""
    n, m = len(a), len(b)
    if not n + m:
        return 0.0
    gone, new = [len(f[1]) + 1.0 for f in a], [len(f[1]) + 1.0 for f in b]
    big = [[0.0] * (n + m) for _ in range(n + m)]
    for i in range(n + m):
        for j in range(n + m):
            if i < n and j < m:
                big[i][j] = len(set(a[i][1]) ^ set(b[j][1])) + (a[i][0] != b[j][0])
            elif i < n:
                big[i][j] = gone[i] if j - m == i else float(10**6)
            elif j < m:
                big[i][j] = new[j] if i - n == j else float(10**6)
    return sum(big[i][j] for i, j in enumerate(assignment(big)))


def mapped_cost(a: Graph, b: Graph, to: list[int | None]) -> float:
    """The cost of a map from a's constants to b's (None: deleted); what nothing maps to is inserted."""
    total = sum(float(a[0][v] != b[0][w]) for v, w in enumerate(to) if w is not None)
    total += sum(w is None for w in to) + len(b[0]) - sum(w is not None for w in to)
    named = [(p, tuple(sorted(to[v] if to[v] is not None else -1 - v for v in m))) for p, m in a[1]]
    return total + fact_cost(named, b[1])


def bipartite(a: Graph, b: Graph) -> float:
    """An upper bound by the assignment of constants with the most alike facts."""
    n, m = len(a[0]), len(b[0])
    around = lambda g, v: sorted((p, len(x)) for p, x in g[1] if v in x)

    def unlike(v: int, w: int) -> float:
        x, y = around(a, v), around(b, w)
        shared = 0
        for item in set(x):
            shared += min(x.count(item), y.count(item))
        return len(x) + len(y) - 2 * shared + (a[0][v] != b[0][w])

    size = n + m
    big = [[0.0] * size for _ in range(size)]
    for i in range(size):
        for j in range(size):
            if i < n and j < m:
                big[i][j] = unlike(i, j)
            elif i < n:
                big[i][j] = 1.0 + len(around(a, i))
            elif j < m:
                big[i][j] = 1.0 + len(around(b, j))
    pick = assignment(big) if size else []
    return mapped_cost(a, b, [pick[v] if pick[v] < m else None for v in range(n)])


def exact(a: Graph, b: Graph, max_steps: int = MAX_STEPS) -> float | None:
    """The edit distance over all maps of constants, None beyond ``max_steps`` maps looked at."""
    n, m = len(a[0]), len(b[0])
    best, tick, steps = bipartite(a, b), count(), 0
    start = (float(abs(n - m)), next(tick), 0.0, ())
    heap = [start]
    while heap:
        bound, _, done, to = heapq.heappop(heap)
        if bound >= best:
            break
        steps += 1
        if steps > max_steps:
            return None
        v = len(to)
        if v == n:
            best = min(best, mapped_cost(a, b, list(to)))
            continue
        used = {w for w in to if w is not None}
        for w in [*(w for w in range(m) if w not in used), None]:
            cost = done + (1.0 if w is None else float(a[0][v] != b[0][w]))
            rest_a, rest_b = n - v - 1, m - len(used) - (w is not None)
            heapq.heappush(heap, (cost + abs(rest_a - rest_b), next(tick), cost, (*to, w)))
    return best


def edit_distances(pairs: DataFrame) -> DataFrame:
    """(a, b, exact, upper, censored) of pairs with types_a, facts_a, types_b and facts_b."""

    def graph(types, facts) -> Graph:
        return [int(t) for t in types], [(int(f["pred"]), tuple(sorted(int(v) for v in f["members"]))) for f in facts]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                a, b = graph(r.types_a, r.facts_a), graph(r.types_b, r.facts_b)
                out.append((r.a, r.b, exact(a, b), bipartite(a, b)))
            frame = pd.DataFrame(out, columns=["a", "b", "exact", "upper"]).astype({"exact": "float64", "upper": "float64"})
            frame["censored"] = frame["exact"].isna()
            yield frame

    cols = ["a", "b", "types_a", "facts_a", "types_b", "facts_b"]
    found = pairs.select(*cols).mapInPandas(work, "a long, b long, exact double, upper double, censored boolean")
    return found.withColumn("exact", F.nanvl("exact", F.lit(None).cast("double")))
