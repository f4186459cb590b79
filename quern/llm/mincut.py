"""Least cut of a graph whose nodes hang between two terminals (Dinic's maximum flow)."""

from __future__ import annotations

from collections import deque


def least_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side.

    source[i], sink[i]: capacity from the source to node i and from it to the sink, so what it costs to
    part the node from either. edges: (i, j, capacity) both ways. Of equal cuts, the one with the
    fewest nodes on the source's side.
    """
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(u: int, v: int, forth: int, back: int) -> None:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((forth, back))

    for i in range(n):
        through = min(source[i], sink[i])
        if source[i] > through:
            add(s, i, source[i] - through, 0)
        if sink[i] > through:
            add(i, t, sink[i] - through, 0)
    for i, j, w in edges:
        add(i, j, w, w)

    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            own = head[u]
            while turn[u] < len(own):
                e = own[turn[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]
