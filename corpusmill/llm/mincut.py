"""Two labels for the nodes of a graph at least cost: terminal capacities, smoothness edges and a maximum flow.

Labels that no cut can change are settled first: a node whose own capacity outweighs all its edges takes its label, its
edges become capacities of its neighbours, and so on. What is left goes through Dinic's algorithm. Both are exact.
"""

from __future__ import annotations

from collections import deque


def label(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for each node on the source's side of the minimum cut (of several the one with fewest such nodes).

    ``source[i]`` is what it costs to part node i from the source, ``sink[i]`` from the sink; (i, j, c) costs c where i
    and j are parted. Whole numbers, none negative.
    """
    n = len(source)
    net = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    weight = [sum(d.values()) for d in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or -weight[i] < net[i] <= weight[i]:
            continue
        side[i] = net[i] > weight[i]
        for j, c in near[i].items():
            if side[j] is None:
                net[j] += c if side[i] else -c
                weight[j] -= c
                del near[j][i]
                todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = [(place[i], place[j], c) for i in rest for j, c in near[i].items() if i < j and side[j] is None]
        for i, s in zip(rest, _flow([net[i] for i in rest], inner), strict=True):
            side[i] = s
    return side


def _flow(net: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's algorithm, level by level with the path held on a stack; who is reached from the source in the end."""
    n = len(net)
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i, v in enumerate(net):
        if v > 0:
            join(s, i, v, 0)
        elif v < 0:
            join(i, t, -v, 0)
    for i, j, c in edges:
        join(i, j, c, c)
    while True:
        level, queue = [-1] * (n + 2), deque([s])
        level[s] = 0
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path = [0] * (n + 2), []
        while True:
            a = to[path[-1]] if path else s
            if a == t:
                pushed = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= pushed
                    cap[e ^ 1] += pushed
                del path[next(k for k, e in enumerate(path) if not cap[e]) :]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
            elif path:
                turn[to[path.pop() ^ 1]] += 1
            else:
                break
