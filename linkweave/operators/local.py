"""Order-dependent graph algorithms that work on one component at a time.

Components are found by Spark and dealt to tasks; each of these functions sees one component of at most ``MOST_EDGES`` edges, and
larger ones are refused rather than cut: they need one of the distributed clusterings first.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from linkweave.operators.components import connected_components

MOST_EDGES = 5_000_000


def by_component(cells: DataFrame, work: Callable[[dict[int, dict[int, float]]], pd.DataFrame], schema: str) -> DataFrame:
    """Applies ``work`` to each component's adjacency {node: {neighbour: weight}} (loops left out)."""
    e = cells.filter("col <> row")
    c = connected_components(e, "col", "row").select(F.col("node").alias("col"), "component")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > MOST_EDGES:
            raise ValueError(f"a component has {len(p)} arcs; the limit is {MOST_EDGES}")
        adj: dict[int, dict[int, float]] = defaultdict(dict)
        for a, b, w in sorted(zip(p["col"].tolist(), p["row"].tolist(), p["val"].tolist())):
            adj[a][b] = w
        return work(adj)

    return e.join(c, "col").groupBy("component").applyInPandas(one, schema)


def max_flow(adj: dict[int, dict[int, float]], source: int, sink: int) -> float:
    """The largest flow between two nodes whose arcs are capacities, by level graphs and blocking paths."""
    cap = {v: dict(n) for v, n in adj.items()}
    flow = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for u, c in cap[v].items():
                if c > 1e-12 and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return flow
        todo = {v: iter(sorted(n)) for v, n in cap.items()}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                low = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= low
                    cap[b][a] = cap[b].get(a, 0.0) + low
                flow += low
                path = [source]
                continue
            for u in todo[v]:
                if cap[v].get(u, 0.0) > 1e-12 and level.get(u, -1) == level[v] + 1:
                    path.append(u)
                    break
            else:
                level[v] = -1
                path.pop()


def pair_flows(adj: dict[int, dict[int, float]]) -> pd.DataFrame:
    """(u, v, flow), u < v, of all pairs of nodes of a component."""
    nodes = sorted(adj)
    rows = [(u, v, max_flow(adj, u, v)) for i, u in enumerate(nodes) for v in nodes[i + 1 :]]
    return pd.DataFrame(rows, columns=["u", "v", "flow"])
