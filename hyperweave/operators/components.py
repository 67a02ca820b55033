"""Connected components of links, for any number of nodes and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.state import hot_keys, look_up, written


def linked(links: DataFrame, keys: tuple[str, ...] = (), few: int = 0) -> DataFrame:
    """(keys, node, comp): the smallest node that each linked node reaches; ``links`` has keys, u and v.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by doubling, and puts
    the roots in the links' place, without loops and repetitions. At least half of the nodes go in a round, so
    rounds are few. Nodes of many links and roots of many nodes are hot keys, which are not dealt out. In tables of
    at most ``few`` rows, which any one task could hold, hot keys are not looked for; two doublings go in one write there.
    """
    hot = lambda rows, on, n: None if n <= few else hot_keys(rows, on, n)
    of_u, of_v, of_up, of_comp = [*keys, "u"], [*keys, "v"], [*keys, "up"], [*keys, "comp"]
    links = links.select(*keys, "u", "v").where("u <> v")
    links = written(links.unionByName(links.select(*keys, F.col("u").alias("v"), F.col("v").alias("u"))).distinct())
    labels = None
    while True:
        least = links.groupBy(*of_u).agg(F.min("v").alias("v"))
        up = written(least.select(*keys, F.col("u").alias("node"), F.least("u", "v").alias("up")))
        nodes, moved = up.count(), True
        while moved:
            if nodes <= few:
                ahead = up.select(*keys, F.col("node").alias("up"), F.col("up").alias("next"))
                up = look_up(up, of_up, ahead, None).select(*keys, "node", F.col("next").alias("up"))
            ahead = up.select(*keys, F.col("node").alias("up"), F.col("up").alias("next"))
            new = look_up(up, of_up, ahead, hot(up, of_up, nodes))
            new = written(new.select(*keys, "node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
            moved = new.where("moved").limit(1).count() > 0
            up = new.select(*keys, "node", "up")
        if labels is None:
            every = nodes  # labels stay one row for each node
            labels = up.select(*keys, "node", F.col("up").alias("comp"))
        else:
            root = up.select(*keys, F.col("node").alias("comp"), "up")
            new = look_up(labels, of_comp, root, hot(labels, of_comp, every), "left")
            labels = written(new.select(*keys, "node", F.coalesce("up", "comp").alias("comp")))
        first = up.select(*keys, F.col("node").alias("u"), F.col("up").alias("first"))
        second = up.select(*keys, F.col("node").alias("v"), F.col("up").alias("second"))
        wide = hot(links, of_u, links.count())  # links go both ways: the same nodes are hot on the other side
        links = look_up(links, of_u, first, wide)
        links = look_up(links, of_v, second, wide and wide.withColumnRenamed("u", "v")).where("first <> second")
        links = written(links.select(*keys, F.col("first").alias("u"), F.col("second").alias("v")).distinct())
        if not links.limit(1).count():
            return labels
