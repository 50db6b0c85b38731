"""Small graphs of many families, and plain Python versions of the operators."""

from __future__ import annotations

import random
from collections import defaultdict, deque


def grid(rows: int, columns: int) -> list[tuple[int, int]]:
    """Streets to the right and down."""
    at = lambda r, c: r * columns + c
    right = [(at(r, c), at(r, c + 1)) for r in range(rows) for c in range(columns - 1)]
    return right + [(at(r, c), at(r + 1, c)) for r in range(rows - 1) for c in range(columns)]


def caterpillar(spine: int, legs: int) -> list[tuple[int, int]]:
    """A spine whose joints each point at legs of their own."""
    body = [(i, i + 1) for i in range(spine - 1)]
    return body + [(i, spine + i * legs + j) for i in range(spine) for j in range(legs)]


def bipartite(left: int, right: int, each: int) -> list[tuple[int, int]]:
    """Every left vertex points at `each` right ones, a fixed stride apart; the right ones point at nothing."""
    return [(i, left + (i * 5 + j * 3) % right) for i in range(left) for j in range(each)]


def hubs_of_hubs(fans: int, leaves: int) -> list[tuple[int, int]]:
    """One vertex points at fans, each fan at leaves, and each leaf back at the first vertex."""
    out = [(0, 1 + f) for f in range(fans)]
    for f in range(fans):
        for x in range(leaves):
            leaf = 1 + fans + f * leaves + x
            out += [(1 + f, leaf), (leaf, 0)]
    return out


def wheel(rim: int) -> list[tuple[int, int]]:
    return [(1 + i, 1 + (i + 1) % rim) for i in range(rim)] + [(0, 1 + i) for i in range(0, rim, 2)] + [(1 + i, 0) for i in range(1, rim, 2)]


def braid(strands: int, length: int, rng: random.Random) -> list[tuple[int, int]]:
    """Layers of vertices with random threads to the next layer, some of them doubled, and a loop in each layer."""
    out = []
    for layer in range(length - 1):
        threads = [(layer * strands + s, (layer + 1) * strands + rng.randrange(strands)) for s in range(strands)]
        out += threads + threads[: layer % 3] + [(layer * strands, layer * strands)]
    return out


def shapes() -> dict[str, tuple[int, list[tuple[int, int]]]]:
    """name -> (vertices, edges)."""
    rng = random.Random(77)
    archipelago = [e for k in range(6) for e in [(7 * k + a, 7 * k + (a * 3 + 1) % 5) for a in range(5)]]
    return {
        "grid": (54, grid(6, 9)),
        "caterpillar": (12 + 12 * 3, caterpillar(12, 3)),
        "bipartite": (33, bipartite(20, 13, 4)),
        "hubs": (1 + 8 + 8 * 12, hubs_of_hubs(8, 12)),
        "wheel": (24, wheel(23)),
        "braid": (9 * 8, braid(9, 8, rng)),
        "archipelago": (44, archipelago),  # islands of 5, and vertices without edges between them
        "lone": (2, []),
        "loops only": (3, [(0, 0), (2, 2), (2, 2)]),
        "scatter": (90, [(rng.randrange(90), min(rng.randrange(90), rng.randrange(90))) for _ in range(260)]),
    }


def union() -> tuple[int, list[tuple[int, int, float]]]:
    """All shapes side by side, with weights; all edges from some of the vertices have weight 0."""
    rng, base, edges = random.Random(19), 0, []
    for n, es in shapes().values():
        edges += [(base + a, base + b, rng.randint(3, 96) / 32) for a, b in es]
        base += n
    zero = set(rng.sample(range(base), 25))
    return base, [(a, b, 0.0 if a in zero else w) for a, b, w in edges]


def stored(edges, directed):
    out = [(i, *e) for i, e in enumerate(edges)]
    return out if directed else out + [(i, b, a, w) for i, a, b, w in out if a != b]


def plain_pagerank(n, edges, directed, p, alpha, steps):
    """Iterate from p; edges are (src, dst, weight)."""
    rows, total = stored(edges, directed), defaultdict(float)
    for _, a, _, w in rows:
        total[a] += w
    rank = list(p)
    for _ in range(steps):
        held = sum(rank[v] for v in range(n) if not total[v] > 0)
        new = [(1 - alpha + alpha * held) * p[v] for v in range(n)]
        for _, a, b, w in rows:
            if total[a] > 0:
                new[b] += alpha * rank[a] * w / total[a]
        rank = new
    return rank


def plain_bfs(n, edges, directed, sources, direction):
    near = defaultdict(set)
    for _, a, b, _ in stored(edges, directed):
        if direction in ("out", "both") or not directed:
            near[a].add(b)
        if direction in ("in", "both") and directed:
            near[b].add(a)
    dist, parent, queue = {s: 0 for s in sources}, {s: -1 for s in sources}, deque(sorted(set(sources)))
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b not in dist:
                dist[b] = dist[a] + 1
                queue.append(b)
    for b, d in dist.items():
        if d:
            parent[b] = min(a for a in dist if dist[a] == d - 1 and b in near[a])
    return {v: (dist.get(v, -1), parent.get(v, -1)) for v in range(n)}


def plain_wcc(n, edges):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b, _ in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    roots = [root(v) for v in range(n)]
    number = {r: i for i, r in enumerate(sorted(set(roots)))}
    return [number[r] for r in roots]


def plain_khop(n, edges, directed, seeds, k, direction, max_vertices=None, max_edges=None):
    dist = {v: d for v, (d, _) in plain_bfs(n, edges, directed, seeds, direction).items() if 0 <= d <= k}
    inside = sorted(sorted(dist, key=lambda v: (dist[v], v))[:max_vertices])
    ids = [i for i, (a, b, _) in enumerate(edges) if a in set(inside) and b in set(inside)]
    return inside, ids[:max_edges]
