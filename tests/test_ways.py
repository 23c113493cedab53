import heapq
import itertools
import random

import numpy as np
import pytest
from oracle import DATA, same

from fleetloom.operators import charging, graph, routes
from fleetloom.plans import stateful, ways
from fleetloom.plans.fleet import ORACLES, QUERIES

SQL = ["outage_overlay", "charger_routes", "nearest_node", "simplified_soc_curve", "heavy_hitters", "long_way_overlay", "charge_at_once", "charge_plan_first"]


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, name):
    assert getattr(ways, name) and same(QUERIES[name](spark, f"{DATA}/sf0.01"), ORACLES[name], f"{DATA}/sf0.01") > 0


def test_nearest_node_is_that_of_all_nodes(spark):
    rng = random.Random(3)
    places = [(i, rng.random() * 10 - 5, rng.random() * 10 - 5) for i in range(200)] + [(200, None, 1.0), (201, 900.0, 900.0)]
    nodes = [(i, rng.random() * 10 - 5, rng.random() * 10 - 5) for i in range(400)] + [(400, None, None)]
    got = {r.id: r.node for r in routes.snap(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(nodes, "node long, nx double, ny double"), 2.0).collect()}
    near = lambda x, y: min((((x - a) ** 2 + (y - b) ** 2), n) for n, a, b in nodes[:-1])[1]
    assert len(got) == 202 and got[200] is None and got[201] is None and all(got[i] == near(x, y) for i, x, y in places[:200])


def test_routes_are_as_long_as_their_distance(spark):
    rng = random.Random(4)
    edges = {(a, b): rng.randrange(1, 9) for a, b in ((rng.randrange(50), rng.randrange(50)) for _ in range(120)) if a < b}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "a long, b long, len long")
    near = graph.nearest_source(df, spark.createDataFrame([(3,), (30,)], "node long"))
    at = {r.node: (r.dist, r.source) for r in near.collect()}
    found = routes.walk(near.select(near["node"].alias("id"), "node"), routes.next_hops(df, near)).collect()
    for start, (dist, source) in at.items():
        way = [r.node for r in sorted((r for r in found if r.id == start), key=lambda r: r.step)]
        assert way[0] == start and way[-1] == source
        assert sum(edges[min(x), max(x)] for x in itertools.pairwise(way)) == dist


def dijkstra(edges, sources):
    beside = {}
    for a, b, n in edges:
        beside.setdefault(a, []).append((b, n))
        beside.setdefault(b, []).append((a, n))
    heap, at = [(0, s, s) for s in sources], {}
    heapq.heapify(heap)
    while heap:
        dist, source, node = heapq.heappop(heap)
        if node not in at:
            at[node] = (dist, source)
            for other, n in beside.get(node, ()):
                heapq.heappush(heap, (dist + n, source, other))
    return at


def test_shortcuts_take_few_rounds_on_a_long_path(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1, rng.randrange(1, 90)) for i in range(10_000)]
    df, sources = spark.createDataFrame(edges, "a long, b long, len long"), spark.createDataFrame([(77,)], "node long")
    made, whole = [], graph.contracted
    monkeypatch.setattr(graph, "contracted", lambda *given, **options: made.append(whole(*given, **options)) or made[-1])
    got = {r.node: (r.dist, r.source) for r in graph.nearest_by_shortcuts(df, sources).collect()}
    assert got == dijkstra(edges, [77])
    ((core, rounds),) = made
    # Each round is undone once; the search takes at most a round for each node that is left.
    assert 2 * len(rounds) + max(1, core.select("a").distinct().count()) <= 40


def test_shortcuts_in_graphs_of_any_shape(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300), rng.randrange(1, 9)) for _ in range(330)]  # loops, parallel edges, parts without a source
    edges += [(0, i, rng.randrange(1, 9)) for i in range(300, 500)] + [(i, i + 1, 1) for i in range(600, 660)] + [(660, 600, 2)]  # a hub and a ring
    df = spark.createDataFrame([*edges, (None, 4, 1), (5, None, 1)], "a long, b long, len long")
    for sources in ([3, 30, 620, 9999], []):
        s = spark.createDataFrame([(x,) for x in [*sources, None]], "node long")
        got = sorted((r.node, r.dist, r.source) for r in graph.nearest_by_shortcuts(df, s).collect())
        assert got == sorted((n, *at) for n, at in dijkstra(edges, sources).items())
    empty = df.limit(0)
    assert [tuple(r) for r in graph.nearest_by_shortcuts(empty, spark.createDataFrame([(1,)], "node long")).collect()] == [(1, 0, 1)]


def test_sampled_ways_keep_both_ends(spark):
    for n in (1, 39, 40, 41, 500):
        got = sorted(r.step for r in routes.sampled(spark.range(n).selectExpr("1 AS id", "id AS step")).collect())
        assert got[0] == 0 and got[-1] == n - 1 and len(got) <= 40 and (n > 39 or len(got) == n)


def recursive(line, tolerance):
    if len(line) < 3:
        return line
    (_, ax, ay), (_, bx, by) = line[0], line[-1]
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy

    def off(p):
        t = max(0.0, min(1.0, ((p[1] - ax) * dx + (p[2] - ay) * dy) / size)) if size else 0.0
        return (p[1] - (ax + t * dx)) ** 2 + (p[2] - (ay + t * dy)) ** 2

    k = max(range(1, len(line) - 1), key=lambda i: (off(line[i]), -i))
    if off(line[k]) <= tolerance * tolerance:
        return [line[0], line[-1]]
    return recursive(line[: k + 1], tolerance)[:-1] + recursive(line[k:], tolerance)


def test_simplified_lines(spark):
    rng = random.Random(6)
    lines = {k: [(i, float(rng.randrange(50)), float(rng.randrange(50))) for i in range(n)] for k, n in ((1, 1), (2, 2), (3, 40), (4, 90))}
    rows = [(k, *p) for k, line in lines.items() for p in line] + [(3, None, 1.0, 1.0), (None, 1, 1.0, 1.0)]
    got = routes.simplified(spark.createDataFrame(rows, "key long, i long, x double, y double"), 7.0).collect()
    assert sorted((r.key, r.i, r.x, r.y) for r in got) == sorted((k, *p) for k, line in lines.items() for p in recursive(line, 7.0))
    assert routes.simplified(spark.createDataFrame([], "key long, i long, x double, y double"), 7.0).count() == 0


def test_plans_cost_no_more_than_charging_at_once(spark):
    for price in (stateful.slot_prices(), [12.0] * 28 + [5.0] * 28):
        for soc in (20.0, 50.0, 79.0):
            one = spark.createDataFrame([(1, 1, 11.0, 50.0, soc)], "vin long, charger long, power double, capacity double, soc double")
            best, plain = (charging.charge_plan(one, price, way=w).first() for w in (charging.cheapest, charging.soonest_steps))
            assert best.feasible and plain.feasible and best.cost <= plain.cost + 1e-9
            steps = [sum(map(int, p.slots.split(","))) for p in (best, plain)]
            assert steps[0] == steps[1]


def test_intervals_join_neighbouring_slots(spark):
    plans = spark.createDataFrame([(1, 7, True, 1.0, "0,2,3,0,0,4,0,1"), (2, 7, True, 0.0, "0,0"), (3, 7, False, 0.0, "")], "vin long, charger long, feasible boolean, cost double, slots string")
    got = sorted(tuple(r) for r in charging.intervals(plans).collect())
    assert got == [(1, 7, 1, 3, pytest.approx(1.25)), (1, 7, 5, 6, pytest.approx(1.0)), (1, 7, 7, 8, pytest.approx(0.25))]
    assert np.isclose(sum(g[4] for g in got), 2.5)


def test_charging_at_once_ends_at_the_very_target():
    price = np.array([5.0, np.inf, 7.0, 9.0])
    cost, used = charging.soonest(50.0, 33.3, 36.0, 7.0, price)
    # 7 kW add 1.6275 kWh a slot below 80 %; the rest of the 2.7 kWh comes in the next free slot.
    assert used * charging.STEP == pytest.approx([1.6275, 0, 1.0725, 0]) and cost == pytest.approx((5 * 1.6275 + 7 * 1.0725) / 0.93)
    assert charging.soonest(50.0, 33.3, 45.0, 7.0, price) is None and charging.soonest(50.0, 40.0, 40.0, 7.0, price)[0] == 0.0
