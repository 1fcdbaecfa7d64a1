"""Routes against Dijkstra's algorithm on a small graph."""

import heapq
import random

import pytest

from metroframe.operators.graph import shortest_path


def plain(edges, start, goal):
    best, heap = {}, [(0.0, start, [start])]
    while heap:
        d, at, path = heapq.heappop(heap)
        if at in best:
            continue
        best[at] = (d, path)
        for a, b, w in edges:
            if a == at and b not in best:
                heapq.heappush(heap, (d + w, b, path + [b]))
    return best.get(goal)


def test_paths_match_dijkstra(spark):
    """Varying starts and goals, a long chain, a goal that cannot be reached, a start that is the goal."""
    rnd = random.Random(4)
    nodes = [(i, float(i * 10), 0.0) for i in range(20)] + [(50, 0.0, 900.0)]
    both = [(i, i + 1, rnd.uniform(10, 12)) for i in range(19)] + [(2, 9, rnd.uniform(60, 90)), (5, 16, rnd.uniform(100, 130)), (0, 3, 31.5)]
    edges = both + [(b, a, w) for a, b, w in both]
    ends = [(0, 19), (19, 0), (7, 7), (3, 50), (18, 4)]
    at = {n: (x, z) for n, x, z in nodes}
    pairs = [(i, *at[a], *at[b]) for i, (a, b) in enumerate(ends)]
    out = shortest_path(
        spark.createDataFrame(nodes, "node long, x double, z double"), spark.createDataFrame(edges, "src long, dst long, w double"),
        spark.createDataFrame(pairs, "pair_id long, sx double, sz double, gx double, gz double"))
    got = {r.pair_id: r for r in out.collect()}
    assert len(got) == len(ends)
    for i, (a, b) in enumerate(ends):
        want = plain(edges, a, b)
        assert got[i].snapped == (want is not None)
        assert got[i].path == (want[1] if want else [])
        if want:
            assert got[i].length == pytest.approx(want[0])
