"""Canonical words of small records: the least fact word over the orders that colour refinement leaves open.

Records that are isomorphic get the same word. Refinement by colours (degrees, then rounds of sorted multisets)
cuts constants into cells; the search tries the orders within cells, individualising one constant at a time and
refining again. Constants that can change places without changing any fact are alike: of those one is tried, and one of
those that an automorphism found on the way takes to each other. The search is bounded by a number of leaves, which
block designs of some dozen constants don't come near; beyond it the record is censored (null word) and stands alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.hypergraph import compact

MAX_LEAVES = 20_000
Fact = tuple[int, tuple[int, ...]]


def refine(n: int, facts: list[Fact], colour: list[int]) -> list[int]:
    """The stable colouring: colours are numbered by sorted signatures, so they don't depend on names."""
    around: list[list[int]] = [[] for _ in range(n)]
    for k, (_, members) in enumerate(facts):
        for v in members:
            around[v].append(k)
    while True:
        sides = [(p, tuple(sorted(colour[v] for v in m))) for p, m in facts]
        marks = [(colour[v], tuple(sorted(sides[k] for k in around[v]))) for v in range(n)]
        number = {s: i for i, s in enumerate(sorted(set(marks)))}
        new = [number[s] for s in marks]
        if len(number) == len(set(colour)):
            return new
        colour = new


def word(types: list[int], facts: list[Fact], rank: list[int]) -> str:
    """The fact word of a record under a numbering of its constants."""
    order = sorted(range(len(types)), key=rank.__getitem__)
    named = sorted({(p, tuple(sorted(rank[v] for v in m))) for p, m in facts})
    return " ".join([f"T{types[v]}" for v in order] + [f"F{p}({','.join(map(str, r))})" for p, r in named])


def alike(facts: list[Fact], u: int, v: int) -> bool:
    """Whether exchanging two constants leaves the facts as they are."""
    own = {(p, m) for p, m in facts if (u in m) != (v in m)}
    change = {u: v, v: u}
    return {(p, tuple(sorted(change.get(w, w) for w in m))) for p, m in own} == {(p, tuple(sorted(m))) for p, m in own}


def _orbits(n: int, autos: list[list[int]], fixed: list[int]) -> list[int]:
    """For each constant the least one of its orbit under the automorphisms found that fix ``fixed``."""
    least = list(range(n))

    def top(v: int) -> int:
        while least[v] != v:
            v = least[v]
        return v

    for auto in autos:
        if all(auto[v] == v for v in fixed):
            for v, w in enumerate(auto):
                v, w = top(v), top(w)
                least[max(v, w)] = min(v, w)
    return [top(v) for v in range(n)]


class _Censored(Exception):
    pass


def canonical_form(types: list[int], facts: list[Fact], max_leaves: int = MAX_LEAVES) -> tuple[str | None, list[int]]:
    """(word, rank of each constant): the least word over all leaves of the refinement tree, None beyond the bound.

    Two leaves of equal facts tell an automorphism. It takes one branch to the other at the node where their paths part, so
    the later branch is left at once, and of the constants of one orbit (under those that fix the path to a node) only
    one is tried.
    """
    n = len(types)
    if not n:
        return "", []
    autos: list[list[int]] = []
    kept: list[tuple] = []  # the first leaf, and the best: (facts, colour, path)
    leaves = 0

    def leaf(colour: list[int], path: list[int]) -> int:
        nonlocal leaves
        leaves += 1
        if leaves > max_leaves:
            raise _Censored
        named = (tuple(types[v] for v in sorted(range(n), key=colour.__getitem__)), sorted({(p, tuple(sorted(colour[v] for v in m))) for p, m in facts}))
        for other, ranks, way in kept:
            if other == named:
                here = {c: v for v, c in enumerate(colour)}
                autos.append([here[c] for c in ranks])
                return next((k for k, (u, v) in enumerate(zip(path, way)) if u != v), len(path))
        if not kept:
            kept.extend([(named, colour, path)] * 2)
        elif named < kept[1][0]:
            kept[1] = (named, colour, path)
        return len(path)

    def search(colour: list[int], path: list[int]) -> int:
        cells: dict[int, list[int]] = {}
        for v, c in enumerate(colour):
            cells.setdefault(c, []).append(v)
        open_cell = next((c for c in sorted(cells) if len(cells[c]) > 1), None)
        if open_cell is None:
            return leaf(colour, path)
        tried: list[int] = []
        for v in cells[open_cell]:
            orbit = _orbits(n, autos, path)
            if any(orbit[u] == orbit[v] or alike(facts, u, v) for u in tried):
                continue
            tried.append(v)
            split = [2 * c + (c == open_cell and w != v) for w, c in enumerate(colour)]
            back = search(refine(n, facts, split), [*path, v])
            if back < len(path):
                return back
        return len(path)

    try:
        search(refine(n, facts, list(types)), [])
    except _Censored:
        return None, []
    return word(types, facts, kept[1][1]), kept[1][1]


def canonical_word(types: list[int], facts: list[Fact], max_leaves: int = MAX_LEAVES) -> str | None:
    return canonical_form(types, facts, max_leaves)[0]


def canonical_words(inc: DataFrame) -> DataFrame:
    """(hg, word): one record a row, constants numbered and facts gathered before the search."""
    ranked = inc.select("hg", "e", "v").join(compact(inc), ["hg", "v"])
    facts = ranked.groupBy("hg", "e").agg(F.sort_array(F.collect_list("new_v")).alias("f"))
    records = facts.groupBy("hg").agg(F.collect_set("f").alias("facts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for facts in f["facts"]:
                own = [(0, tuple(int(v) for v in m)) for m in facts]
                n = 1 + max(v for _, m in own for v in m)
                out.append(canonical_word([0] * n, own))
            yield pd.DataFrame({"hg": f["hg"], "word": out})

    return records.mapInPandas(run, "hg long, word string")


def canonical_classes(inc: DataFrame) -> DataFrame:
    """(word, members, first_hg, censored): isomorphism classes of records; a censored record is a class of its own."""
    words = canonical_words(inc).withColumn("censored", F.col("word").isNull())
    alone = F.concat(F.lit("censored "), F.col("hg").cast("string"))
    named = words.withColumn("word", F.coalesce("word", alone))
    return named.groupBy("word", "censored").agg(F.count("*").alias("members"), F.min("hg").alias("first_hg"))
