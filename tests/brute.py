"""Plain NumPy versions of iterative operators, for small inputs."""

import numpy as np


def pairwise(v):
    return np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))


def reachability(v, min_samples):
    d = pairwise(v)
    core = np.sort(d, axis=1)[:, min_samples]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def mst_brute(v, min_samples):
    """Edges (weight, a, b) of the spanning tree by Kruskal's method."""
    r = reachability(v, min_samples)
    n = len(v)
    edges = sorted((r[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    out = []
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            out.append((w, i, j))
    return out


def hdbscan_brute(v, min_cluster_size, min_samples):
    """Labels by recursive splitting of the spanning tree and excess of mass."""
    n = len(v)
    tree = mst_brute(v, min_samples)
    stability, children, members = {}, {}, {}

    def parts(points, edges):
        left = {p: [] for p in points}
        for w, i, j in edges:
            left[i].append(j)
            left[j].append(i)
        seen, out = set(), []
        for p in points:
            if p in seen:
                continue
            stack, comp = [p], []
            seen.add(p)
            while stack:
                x = stack.pop()
                comp.append(x)
                for y in left[x]:
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            out.append(comp)
        return out

    def grow(name, points, edges, birth):
        """Follow one cluster as edges are removed from the heaviest down."""
        members[name], children[name], total = list(points), [], 0.0
        points, edges = set(points), sorted(edges)
        while edges:
            w = edges.pop()
            lam = 1 / max(w[0], 1e-10)
            a, b = sorted(parts(points, edges), key=len)
            if len(a) >= min_cluster_size:
                total += len(points) * (lam - birth)
                stability[name] = total
                for i, side in enumerate((a, b)):
                    kept = set(side)
                    child = name + (i,)
                    children[name].append(child)
                    grow(child, side, [e for e in edges if e[1] in kept], lam)
                return
            if len(b) < min_cluster_size:
                total += len(points) * (lam - birth)
                stability[name] = total
                return
            total += len(a) * (lam - birth)
            points = set(b)
            edges = [e for e in edges if e[1] in points]
        stability[name] = total

    grow((), range(n), tree, 0.0)

    def best(name):
        below = [best(c) for c in children[name]]
        value = sum(x[0] for x in below)
        if name != () and stability[name] >= value:
            return stability[name], [name]
        return value, [c for x in below for c in x[1]]

    labels = np.full(n, -1)
    for i, name in enumerate(best(())[1]):
        labels[members[name]] = i
    return labels
