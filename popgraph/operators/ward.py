"""Ward linkage over weighted points, for tables of bounded size."""

from __future__ import annotations

import numpy as np


def ward_merges(points: np.ndarray, sizes: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of all merges, by a chain of nearest neighbours; ``b`` goes into ``a``, the smaller place.

    The cost of a merge is the growth of the summed squared distances to the centre. A
    cluster is its centre and its size, which is all that Ward's update of distances
    needs. The chain goes from each cluster to its nearest until two are each other's
    nearest; these are merged. Costs never shrink along merges, so in the order of costs
    the merges are those of the plain method.
    """
    at, n = points.astype(float).copy(), sizes.astype(float).copy()
    alive = np.ones(len(at), bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < len(at) - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        top = chain[-1]
        cost = n[top] * n / (n[top] + n) * ((at - at[top]) ** 2).sum(axis=1)
        cost[~alive] = np.inf
        cost[top] = np.inf
        near = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
            a, b = sorted((top, chain[-2]))
            merges.append((float(cost[chain[-2]]), a, b))
            at[a] = (n[a] * at[a] + n[b] * at[b]) / (n[a] + n[b])
            n[a] += n[b]
            alive[b] = False
            del chain[-2:]
        else:
            chain.append(near)
    return merges


def ward_labels(points: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` clusters (fewer points: one each), numbered by their first points."""
    into = np.arange(len(points))
    order = sorted(ward_merges(points, sizes), key=lambda m: m[0])  # stable: a merge comes after those inside it

    def root(i: int) -> int:
        while into[i] != i:
            into[i] = into[into[i]]
            i = into[i]
        return i

    for _, a, b in order[: max(len(points) - k, 0)]:
        a, b = sorted((root(a), root(b)))
        into[b] = a
    roots = [root(i) for i in range(len(points))]
    number = {r: j for j, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots], int)
