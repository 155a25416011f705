"""Filtered graphs of similarity matrices and centrality on them: sequential by nature, so one formation's graph is one task's."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Edges = list[tuple[int, int, float]]


def matrix(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted({*pdf["i"], *pdf["j"]})
    at = {n: k for k, n in enumerate(names)}
    w = np.full((len(names), len(names)), np.nan)
    for i, j, x in zip(pdf["i"], pdf["j"], pdf["w"]):
        w[at[i], at[j]] = w[at[j], at[i]] = x
    return names, w


def tmfg(w: np.ndarray) -> Edges:
    """Triangulated graph of 3(n - 2) edges: from the four heaviest nodes on, the node and face of the largest gain come next (Massara, Di Matteo
    and Aste, 2016).

    The best node of each face is kept, and found anew only when that node has been placed; of equal gains the least node, then the
    oldest face.
    """
    n = len(w)
    if n < 4:
        raise ValueError("need at least four nodes")
    a = np.nan_to_num(w, nan=0.0)
    np.fill_diagonal(a, 0)
    seed = [int(i) for i in np.argsort(-a.sum(axis=1), kind="stable")[:4]]
    edges = [(seed[i], seed[j], a[seed[i], seed[j]]) for i in range(4) for j in range(i + 1, 4)]
    free = np.ones(n, bool)
    free[seed] = False
    faces: list[list[int]] = []
    gain, node = np.full(3 * n, -np.inf), np.full(3 * n, n)  # by face; a face that is used up has no gain

    def look(f: int) -> None:
        left = np.flatnonzero(free)
        total = a[left][:, faces[f]].sum(axis=1)
        k = int(total.argmax())
        gain[f], node[f] = total[k], left[k]

    def add(face: list[int]) -> None:
        faces.append(face)
        if free.any():
            look(len(faces) - 1)

    for i in (3, 2, 1, 0):
        add(sorted(seed[:i] + seed[i + 1 :]))
    while free.any():
        best = np.flatnonzero(gain == gain.max())
        f = int(best[node[best].argmin()])
        v, face = int(node[f]), faces[f]
        edges += [(v, u, a[v, u]) for u in face]
        free[v], gain[f], node[f] = False, -np.inf, n
        for pair in ((face[0], face[1]), (face[0], face[2]), (face[1], face[2])):
            add(sorted((v, *pair)))
        if free.any():
            for f in np.flatnonzero(node == v).tolist():
                look(f)
    return edges


def is_planar(n: int, edges: list[tuple[int, int]]) -> bool:
    """Left-right planarity test (de Fraysseix and Rosenstiehl; in the form of U. Brandes, The left-right planarity test, 2009): depth-first
    orientation, then constraints on return edges kept in a stack of conflict pairs."""
    if n > 2 and len(edges) > 3 * n - 6:
        return False
    adj: dict[int, list[int]] = defaultdict(list)
    for u, v in edges:
        adj[u].append(v)
        adj[v].append(u)
    height: dict[int, int] = {}
    parent: dict[int, tuple[int, int] | None] = {}
    low: dict[tuple[int, int], int] = {}
    low2: dict[tuple[int, int], int] = {}
    nest: dict[tuple[int, int], int] = {}
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    done: set[tuple[int, int]] = set()

    def orient(root: int) -> None:
        height[root], parent[root] = 0, None
        stack = [(root, iter(adj[root]))]
        while stack:
            v, it = stack[-1]
            for w in it:
                if (v, w) in done or (w, v) in done:
                    continue
                e = (v, w)
                done.add(e)
                out[v].append(e)
                low[e] = low2[e] = height[v]
                if w not in height:
                    height[w], parent[w] = height[v] + 1, e
                    stack.append((w, iter(adj[w])))
                    break
                low[e] = height[w]
                close(e, v)
            else:
                stack.pop()
                if parent[v] is not None:
                    close(parent[v], parent[v][0])

    def close(e: tuple[int, int], v: int) -> None:
        nest[e] = 2 * low[e] + (low2[e] < height[v])
        p = parent[v]
        if p is not None:
            if low[e] < low[p]:
                low2[p] = min(low[p], low2[e])
                low[p] = low[e]
            elif low[e] > low[p]:
                low2[p] = min(low2[p], low[e])
            else:
                low2[p] = min(low2[p], low2[e])

    roots = []
    for v in range(n):
        if v not in height:
            roots.append(v)
            orient(v)
    for v in out:
        out[v].sort(key=nest.__getitem__)
    ref: dict[tuple, tuple | None] = {}
    low_edge: dict[tuple, tuple] = {}
    bottom: dict[tuple, object] = {}
    stack: list[list] = []  # conflict pairs [[low, high], [low, high]] of left and right intervals
    empty = lambda i: i[0] is None and i[1] is None
    clash = lambda i, b: not empty(i) and low[i[1]] > low[b]

    def lowest(p: list) -> int:
        if empty(p[0]):
            return low[p[1][0]]
        if empty(p[1]):
            return low[p[0][0]]
        return min(low[p[0][0]], low[p[1][0]])

    def constrain(ei: tuple, e: tuple) -> bool:
        pair = [[None, None], [None, None]]
        while True:
            q = stack.pop()
            if not empty(q[0]):
                q.reverse()
            if not empty(q[0]):
                return False
            if low[q[1][0]] > low[e]:
                if empty(pair[1]):
                    pair[1][1] = q[1][1]
                else:
                    ref[pair[1][0]] = q[1][1]
                pair[1][0] = q[1][0]
            else:
                ref[q[1][0]] = low_edge[e]
            if (stack[-1] if stack else None) is bottom[ei]:
                break
        while stack and (clash(stack[-1][0], ei) or clash(stack[-1][1], ei)):
            q = stack.pop()
            if clash(q[1], ei):
                q.reverse()
            if clash(q[1], ei):
                return False
            ref[pair[1][0]] = q[1][1]
            if q[1][0] is not None:
                pair[1][0] = q[1][0]
            if empty(pair[0]):
                pair[0][1] = q[0][1]
            else:
                ref[pair[0][0]] = q[0][1]
            pair[0][0] = q[0][0]
        if not (empty(pair[0]) and empty(pair[1])):
            stack.append(pair)
        return True

    def trim(e: tuple) -> None:
        u = e[0]
        while stack and lowest(stack[-1]) == height[u]:
            stack.pop()
        if stack:
            p = stack.pop()
            for side, other in ((0, 1), (1, 0)):
                while p[side][1] is not None and p[side][1][1] == u:
                    p[side][1] = ref.get(p[side][1])
                if p[side][1] is None and p[side][0] is not None:
                    ref[p[side][0]] = p[other][0]
                    p[side][0] = None
            stack.append(p)
        if low[e] < height[u] and stack:
            hl, hr = stack[-1][0][1], stack[-1][1][1]
            ref[e] = hl if hl is not None and (hr is None or low[hl] > low[hr]) else hr

    def visit(root: int) -> bool:
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            e = parent[v]
            if i:  # back from the child of the edge before
                ei = out[v][i - 1]
                if not settle(v, ei, e):
                    return False
            descended = False
            while i < len(out[v]):
                ei = out[v][i]
                i += 1
                bottom[ei] = stack[-1] if stack else None
                if ei == parent[ei[1]]:
                    work.append((v, i))
                    work.append((ei[1], 0))
                    descended = True
                    break
                low_edge[ei] = ei
                stack.append([[None, None], [ei, ei]])
                if not settle(v, ei, e):
                    return False
            if not descended and e is not None:
                trim(e)
        return True

    def settle(v: int, ei: tuple, e: tuple | None) -> bool:
        if low[ei] < height[v]:
            if ei == out[v][0]:
                low_edge[e] = low_edge[ei]
            elif not constrain(ei, e):
                return False
        return True

    return all(visit(r) for r in roots)


def pmfg(w: np.ndarray, max_candidates: int | None = None) -> Edges:
    """Edges from the heaviest down that keep the graph planar, until there are 3(n - 2). Missing weights are no edges."""
    n = len(w)
    i, j = np.triu_indices(n, 1)
    keep = np.isfinite(w[i, j])
    i, j = i[keep], j[keep]
    order = np.argsort(-w[i, j], kind="stable")[:max_candidates]
    out: Edges = []
    for k in order:
        if len(out) == 3 * (n - 2):
            break
        e = (int(i[k]), int(j[k]), float(w[i[k], j[k]]))
        if len(out) < 8 or is_planar(n, [x[:2] for x in out] + [e[:2]]):
            out.append(e)
    return out


# ------------------------------------------------------------------ centrality


def shortest(n: int, adj: dict[int, list[tuple[int, float]]], s: int) -> tuple[list[int], np.ndarray, np.ndarray, list[list[int]]]:
    """Nodes by distance from s, distances, numbers of shortest paths, predecessors."""
    dist, paths, pred, order = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)], []
    dist[s], paths[s] = 0, 1
    heap, done = [(0.0, s)], [False] * n
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for u, w in adj[v]:
            x = d + w
            if x < dist[u] - 1e-12:
                dist[u], paths[u], pred[u] = x, paths[v], [v]
                heapq.heappush(heap, (x, u))
            elif abs(x - dist[u]) <= 1e-12 and not done[u]:
                paths[u] += paths[v]
                pred[u].append(v)
    return order, dist, paths, pred


def distances(n: int, edges: Edges, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Betweenness (share of pairs), eccentricity and closeness; an edge is as long as one over its weight, or one."""
    adj: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for u, v, w in edges:
        d = 1 / w if weighted and w > 0 else 1.0
        adj[u].append((v, d))
        adj[v].append((u, d))
    between, ecc, close = np.zeros(n), np.zeros(n), np.zeros(n)
    for s in range(n):
        order, dist, paths, pred = shortest(n, adj, s)
        ecc[s], close[s] = dist[order].max(), (len(order) - 1) / dist[order].sum() if len(order) > 1 else 0
        share = np.zeros(n)
        for v in reversed(order):
            for p in pred[v]:
                share[p] += paths[p] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
    return between / max((n - 1) * (n - 2), 1), ecc, close


def centrality(n: int, edges: Edges, tie: str = "floor") -> pd.DataFrame:
    """Summed ranks of degree, betweenness, eccentricity, closeness and eigenvector centrality, weighted and not, and X, Y, XY. Small is central.

    Nodes outside the largest component are as peripheral as can be.
    """
    if n < 2:
        raise ValueError("need at least two nodes")
    near = defaultdict(set)
    for u, v, _ in edges:
        near[u].add(v)
        near[v].add(u)
    seen, parts = set(), []
    for s in range(n):
        if s not in seen:
            part, queue = {s}, deque([s])
            while queue:
                for u in near[queue.popleft()] - part:
                    part.add(u)
                    queue.append(u)
            seen |= part
            parts.append(sorted(part))
    giant = max(parts, key=len)
    if len(giant) < n:
        at = {v: k for k, v in enumerate(giant)}
        inner = centrality(len(giant), [(at[u], at[v], w) for u, v, w in edges if u in at and v in at], tie)
        out = pd.DataFrame(2.0 * n, index=range(n), columns=inner.columns)
        out[["X", "Y", "XY"]] = [1.0, 1.0, 2.0]
        out.loc[giant] = inner.to_numpy()
        return out
    out = pd.DataFrame(0.0, index=range(n), columns=["D", "BC", "E", "C", "EC"])
    for weighted in (True, False):
        a = np.zeros((n, n))
        for u, v, w in edges:
            a[u, v] = a[v, u] = w if weighted else 1.0
        between, ecc, close = distances(n, edges, weighted)
        top = np.abs(np.linalg.eigh(a)[1][:, -1])
        for name, x, down in (("D", a.sum(axis=1), True), ("BC", between, True), ("E", ecc, False), ("C", close, False), ("EC", top, True)):
            r = pd.Series(np.round(x, 10)).rank(ascending=not down)
            out[name] += np.floor(r) if tie == "floor" else r
    out["X"] = (out["D"] + out["BC"] - 4) / (4 * (n - 1))
    out["Y"] = (out["E"] + out["C"] + out["EC"] - 6) / (6 * (n - 1))
    out["XY"] = out["X"] + out["Y"]
    return out


def filtered_graphs(edges: DataFrame, group: str, method: str = "tmfg") -> DataFrame:
    """edges (group, i, j, w) -> group, i, j, w of the filtered graph."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = matrix(pdf)
        kept = (tmfg if method == "tmfg" else pmfg)(w)
        return pd.DataFrame([(pdf[group].iloc[0], *sorted((names[u], names[v])), x) for u, v, x in kept], columns=[group, "i", "j", "w"])

    return edges.select(group, "i", "j", "w").groupBy(group).applyInPandas(work, f"{group} {edges.schema[group].dataType.simpleString()}, i string, j string, w double")


def node_roles(edges: DataFrame, group: str, q: float = 0.25) -> DataFrame:
    """group, node, X, Y, XY, role (peripheral, central or middle by quantiles of XY)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["i"], *pdf["j"]})
        at = {n: k for k, n in enumerate(names)}
        xy = centrality(len(names), [(at[i], at[j], w) for i, j, w in zip(pdf["i"], pdf["j"], pdf["w"])])
        lo, hi = xy["XY"].quantile(q), xy["XY"].quantile(1 - q)
        role = np.where(xy["XY"] >= hi, "peripheral", np.where(xy["XY"] <= lo, "central", "middle"))
        return pd.DataFrame({group: pdf[group].iloc[0], "node": names, "X": xy["X"], "Y": xy["Y"], "XY": xy["XY"], "role": role})

    return edges.select(group, "i", "j", "w").groupBy(group).applyInPandas(work, f"{group} {edges.schema[group].dataType.simpleString()}, node string, X double, Y double, XY double, role string")
