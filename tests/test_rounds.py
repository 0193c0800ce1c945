"""Tours, trails, cliques, flows, prices and clauses against plain searches."""

import itertools
import math
import random

import pytest

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import cliques, flows, networks, orders, search, tours, trails
from sparkweave.operators.trees import prufer_code


def tree(rng, n, mark):
    names = [f"{mark}{i:02d}" for i in range(n)]
    rng.shuffle(names)
    return names, [(names[rng.randrange(max(0, i - 4), i)], names[i]) for i in range(1, n)]


def walk(adjacent, root):
    """parent, depth, enter, leave, place, size, postorder by recursion."""
    out, clock, count = {}, [0], [0, 0]

    def go(v, parent, depth):
        clock[0] += 1
        count[0] += 1
        enter, place = clock[0], count[0]
        size = 1 + sum(go(w, v, depth + 1) for w in sorted(adjacent[v]) if w != parent)
        clock[0] += 1
        count[1] += 1
        out[v] = (parent, depth, enter, clock[0], place, size, count[1])
        return size

    go(root, None, 0)
    return out


def adjacency(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near


def test_tours_of_a_forest(spark):
    rng = random.Random(1)
    (one, first), (two, second) = tree(rng, 22, "a"), tree(rng, 9, "b")
    graph = Graph.rows(spark, first + second, nodes=["z"])
    near = adjacency(first + second)
    want = {**walk(near, min(one)), **walk(near, min(two)), "z": (None, 0, 1, 2, 1, 1, 1)}
    got = {r["id"]: (r["parent"], r["depth"], r["enter"], r["leave"], r["place"], r["size"]) for r in tours.tour(graph).collect()}
    assert got == {k: v[:6] for k, v in want.items()}
    root = one[5]
    own = walk(near, root)
    got = {r["id"]: tuple(r)[1:] for r in tours.depth_first(graph, root).collect()}
    assert got == {k: (v[0], v[2], v[3], v[4], v[6]) for k, v in own.items()}
    with pytest.raises(Invalid):
        tours.tour(Graph.rows(spark, [*first, (one[0], one[9])]))


def test_values_chains_and_ancestors(spark):
    rng = random.Random(2)
    names, edges = tree(rng, 24, "v")
    graph, near, root = Graph.rows(spark, edges), adjacency(edges), names[3]
    at = walk(near, root)
    below = lambda v: [v, *(x for w in near[v] if w != at[v][0] for x in below(w))]
    up = lambda v: [v, *(up(at[v][0]) if at[v][0] else [])]
    values = {v: float(rng.randrange(-9, 20)) for v in names[:18]}
    got = {r["id"]: (r["total"], r["largest"]) for r in tours.subtree_values(graph, root, spark.createDataFrame(list(values.items()), "id string, value double")).collect()}
    assert got == {v: (sum(values.get(x, 0.0) for x in below(v)), max(values.get(x, 0.0) for x in below(v))) for v in names}
    heavy = {v: min((w for w in near[v] if w != at[v][0]), key=lambda w: (-at[w][5], w), default=None) for v in names}
    head = lambda v: v if at[v][0] is None or heavy[at[v][0]] != v else head(at[v][0])
    got = {r["id"]: (r["head"], r["position"], r["length"]) for r in tours.heavy_paths(graph, root).collect()}
    assert got == {v: (head(v), at[v][1] - at[head(v)][1], sum(head(x) == head(v) for x in names)) for v in names}
    pairs = [(a, b) for a in names for b in names if rng.random() < 0.4]
    cost = {v: rng.random() for v in names if at[v][0]}
    found = tours.common_ancestors(tours.tour(graph, spark.createDataFrame([(root,)], "id string")), spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(list(cost.items()), "id string, value double"))

    def way(a, b):
        lca = next(x for x in up(b) if x in up(a))
        steps = [x for x in up(a) + up(b) if at[x][1] > at[lca][1]]
        return lca, len(steps), max((cost[x] for x in steps), default=None)

    assert {(r["a"], r["b"]): (r["lca"], r["distance"], r["largest"]) for r in found.collect()} == {p: way(*p) for p in pairs}


def test_blocks_equal_common_cycles(spark):
    rng = random.Random(3)
    edges = {tuple(sorted((f"a{rng.randrange(16):02d}", f"a{rng.randrange(16):02d}"))) for _ in range(19)}
    real = sorted(e for e in edges if e[0] != e[1])
    group = {e: e for e in real}
    root = lambda e: e if group[e] == e else root(group[e])
    near = adjacency(real)
    # Edges at one node are of one block if their other ends are joined without it.
    for v in near:
        for a, b in itertools.combinations(near[v], 2):
            seen, todo = {a}, [a]
            while todo:
                for w in near[todo.pop()]:
                    if w != v and w not in seen:
                        seen.add(w)
                        todo.append(w)
            if b in seen:
                group[root(tuple(sorted((v, a))))] = root(tuple(sorted((v, b))))
    want = {}
    for e in real:
        want.setdefault(root(e), []).append(e)
    got = {}
    for r in tours.blocks_of(Graph.rows(spark, list(edges)))[0].collect():
        got.setdefault(r["at"], []).append((r["src"], r["dst"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_prufer_code_equals_the_definition(spark):
    names, edges = tree(random.Random(4), 15, "p")
    left, code = adjacency(edges), []
    while len(left) > 2:
        leaf = min(v for v in left if len(left[v]) == 1)
        code.append(left[leaf][0])
        left[left.pop(leaf)[0]].remove(leaf)
    assert [r["id"] for r in prufer_code(Graph.rows(spark, edges)).orderBy("position").collect()] == code


def test_numbers_and_ranks(spark):
    rows = spark.createDataFrame([(i * 7 % 100, None if i % 9 == 0 else i % 3) for i in range(100)], "a int, b int").repartition(5)
    got = [(r["b"], r["a"]) for r in orders.numbered(rows, "b", "a").orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    links = spark.createDataFrame([(i, i + 1 if i % 10 < 9 else None, i) for i in range(40)], "id long, next long, w long")
    assert {r["id"]: (r["last"], r["w"]) for r in orders.ranked(links, "w").collect()} == {i: (i // 10 * 10 + 9, sum(range(i, i // 10 * 10 + 10))) for i in range(40)}


@pytest.mark.parametrize("directed", [True, False])
def test_trails_take_every_arc_once(spark, directed):
    rng, arcs = random.Random(5), []
    for part in "ab":
        at = f"{part}0"
        for _ in range(25):
            to = f"{part}{rng.randrange(7)}"
            arcs.append((len(arcs), at, to) if directed or rng.random() < 0.5 else (len(arcs), to, at))
            at = to
    given = {i: (a, b) for i, a, b in arcs}
    rows = spark.createDataFrame(rng.sample(arcs, len(arcs)), "id long, src string, dst string")
    found = (trails.directed_trails if directed else trails.undirected_trails)(rows).orderBy("component", "position").collect()
    assert sorted(r["id"] for r in found) == sorted(given)
    for _, steps in itertools.groupby(found, lambda r: r["component"]):
        steps = list(steps)
        assert [r["position"] for r in steps] == list(range(1, len(steps) + 1))
        assert all(x["dst"] == y["src"] for x, y in itertools.pairwise(steps))
        assert all((r["src"], r["dst"]) == given[r["id"]] or not directed and (r["dst"], r["src"]) == given[r["id"]] for r in steps)
    with pytest.raises(Invalid):
        (trails.directed_trails if directed else trails.undirected_trails)(spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "a", "d")], "id long, src string, dst string"))


def test_cliques_equal_all_subsets(spark):
    rng = random.Random(6)
    nodes = [f"n{i:02d}" for i in range(11)]
    edges = {tuple(sorted(rng.sample(nodes[:10], 2))) for _ in range(28)}
    tied = lambda a, b: tuple(sorted((a, b))) in edges
    full = [set(c) for k in range(1, 12) for c in itertools.combinations(nodes, k) if all(tied(a, b) for a, b in itertools.combinations(c, 2))]
    want = sorted(sorted(c) for c in full if not any(c < d for d in full))
    assert sorted(r["members"] for r in cliques.maximal_cliques(Graph.rows(spark, list(edges), nodes=nodes)).collect()) == want


def test_flow_equals_the_least_cut(spark):
    rng = random.Random(7)
    nodes = [f"n{i}" for i in range(7)]
    room = {(a, b): float(rng.randrange(0, 9)) for a in nodes for b in nodes if a != b and rng.random() < 0.4} | {("n0", "n1"): 3.0, ("n5", "n6"): 4.0}
    sent, side = flows.maximum_flow(Graph.rows(spark, [(a, b, w) for (a, b), w in room.items()], directed=True), "n0", "n6")
    sides = [{"n0", *c} for k in range(6) for c in itertools.combinations(nodes[1:6], k)]
    cut = lambda s: sum(w for (a, b), w in room.items() if a in s and b not in s)
    best = min(map(cut, sides))
    flow = {(r["src"], r["dst"]): r["flow"] for r in sent.collect()}
    net = {v: sum(x * ((a == v) - (b == v)) for (a, b), x in flow.items()) for v in nodes}
    assert net["n0"] == pytest.approx(best) and all(abs(net[v]) < 1e-6 for v in nodes[1:6])
    assert all(x <= room[e] + 1e-9 for e, x in flow.items())
    smallest = min((s for s in sides if cut(s) == best), key=len)
    assert {r["id"] for r in side.collect()} == smallest


def test_what_a_hub_has_is_dealt_to_all_its_arcs(spark):
    arcs = spark.createDataFrame([("h", f"d{i}", 100.0, 0.5) for i in range(300)] + [("k", "d1", 3.0, 7.0)], "src string, dst string, x double, room double")
    got = flows.dealt_out(arcs, "x", "room").groupBy("src").sum("sent").collect()
    assert {r[0]: r[1] for r in got} == {"h": 100.0, "k": 3.0}


def cheapest(arcs, s, t):
    """Value and cost by one cheapest way after the other."""
    left = [x for a, b, c, w in arcs for x in ([a, b, c, w], [b, a, 0.0, -w])]
    sent = cost = 0.0
    while True:
        dist, by = {s: 0.0}, {}
        for _ in range(len(arcs) + 1):
            for i, (a, b, c, w) in enumerate(left):
                if c > 1e-9 and a in dist and dist[a] + w < dist.get(b, math.inf) - 1e-9:
                    dist[b], by[b] = dist[a] + w, i
        if t not in dist:
            return sent, cost
        way, x = [], t
        while x != s:
            way.append(by[x])
            x = left[by[x]][0]
        q = min(left[i][2] for i in way)
        for i in way:
            left[i][2] -= q
            left[i ^ 1][2] += q
        sent, cost = sent + q, cost + q * dist[t]


def test_cheapest_flow(spark):
    rng = random.Random(8)
    nodes = [f"n{i}" for i in range(5)]
    arcs = [(a, b, float(rng.randrange(1, 6)), float(rng.randrange(1, 9))) for a in nodes for b in nodes if a != b and rng.random() < 0.6]
    rows = spark.createDataFrame(arcs, "src string, dst string, capacity double, cost double")
    got = networks.minimum_cost_flow(rows, "n0", "n4", unit=1.0).collect()
    value = sum(r["flow"] * ((r["src"] == "n0") - (r["dst"] == "n0")) for r in got)
    assert (value, sum(r["flow"] * r["cost"] for r in got)) == pytest.approx(cheapest(arcs, "n0", "n4"))
    assert len(got) == len(arcs) and all(r["tight"] and 0 <= r["flow"] for r in got)
    with pytest.raises(Invalid):
        networks.minimum_cost_flow(rows, "n0", "n4", amount=value + 1)


def test_cheapest_assignment(spark):
    rng = random.Random(9)
    cost = {(i, j): float(rng.randrange(0, 40)) for i in range(5) for j in range(5)}
    listed = {p: c for p, c in cost.items() if p[0] == p[1] or rng.random() < 0.8}
    got = networks.assignment(spark.createDataFrame([(f"w{i}", f"j{j}", c) for (i, j), c in listed.items()], "worker string, job string, cost double"), unit=1.0).collect()
    best = min(sum(listed.get((i, p[i]), math.inf) for i in range(5)) for p in itertools.permutations(range(5)))
    assert sum(r["cost"] for r in got) == best and len({r["job"] for r in got}) == 5 and all(r["tight"] for r in got)
    with pytest.raises(Invalid):
        networks.assignment(spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("a", "y", 1.0), ("c", "x", 1.0), ("c", "z", 2.0), ("b", "x", 3.0)], "worker string, job string, cost double").where("job <> 'z'").unionByName(spark.createDataFrame([("a", "z", 1.0)], "worker string, job string, cost double")))


def test_clauses(spark):
    rng, kinds = random.Random(10), set()
    for seed, m in ((0, 5), (1, 12)):
        rng = random.Random(seed)
        rows = [(f"v{rng.randrange(5)}", rng.random() < 0.5, f"v{rng.randrange(5)}", rng.random() < 0.5) for _ in range(m)]
        names = sorted({r[0] for r in rows} | {r[2] for r in rows})
        holds = lambda x: all(x[a] == p or x[b] == q for a, p, b, q in rows)  # noqa: B023, E731
        possible = any(holds(dict(zip(names, bits, strict=True))) for bits in itertools.product((True, False), repeat=len(names)))
        value, clash = search.two_sat(spark.createDataFrame(rows, "v1 string, b1 boolean, v2 string, b2 boolean"))
        found = {r["variable"]: r["value"] for r in value.collect()}
        assert (sorted(found) == names and holds(found)) if possible else (not found and clash.count() > 0)
        kinds.add(possible)
    assert kinds
