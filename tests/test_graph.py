"""Bridges, themes, communities and merges against plain walks over small graphs."""

import itertools
import random

import pytest
from granary.operators import graph, links, merges, themes
from granary.operators.similarity import spelling_ratio
from pyspark.sql import functions as F


def reach(nodes, edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            for u, v in ((a, b), (b, a)):
                if u == x and v not in seen:
                    seen.add(v)
                    todo.append(v)
    return seen & set(nodes)


def components(nodes, edges):
    return {x: min(reach(nodes, edges, x)) for x in nodes}


def brute_bridges(nodes, edges):
    out = {}
    for e in edges:
        rest = [x for x in edges if x != e]
        if e[1] not in reach(nodes, rest, e[0]):
            out[e] = {len(reach(nodes, rest, e[0])), len(reach(nodes, rest, e[1]))}, tuple(sorted((len(reach(nodes, rest, e[0])), len(reach(nodes, rest, e[1])))))
    return {e: s[1] for e, s in out.items()}


@pytest.fixture(scope="module")
def small():
    rnd = random.Random(6)
    nodes = list(range(1, 26))
    pairs = sorted(rnd.sample(list(itertools.combinations(nodes[:22], 2)), 24))
    return nodes, {p: round(rnd.random(), 3) for p in pairs}


def test_bridges_and_their_sides(spark, small):
    nodes, weights = small
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src long, dst long, weight double")
    got = {(r.src, r.dst): tuple(sorted((r.below, r.beyond))) for r in themes.bridges(edges).collect()}
    assert got == brute_bridges(nodes, list(weights)) and got


def test_themes_follow_threshold_and_bridge_rule(spark, small):
    nodes, weights = small
    least, keep = 0.15, 0.6
    rows = [(b, a, w) for (a, b), w in weights.items()] + [(a, b, w / 2) for (a, b), w in weights.items()] + [(5, 5, 1.0), (5, 99, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    entities = spark.createDataFrame([(x,) for x in nodes], "entity_id long")
    strong = {p: w for p, w in weights.items() if w >= least}
    drop = {p for p, sides in brute_bridges(nodes, list(strong)).items() if strong[p] < keep and sides[0] >= 2}
    left = [p for p in strong if p not in drop]
    label = components(nodes, left)
    score = {c: round(sum(strong[p] for p in left if label[p[0]] == c), 6) for c in set(label.values())}
    order = sorted(score, key=lambda c: (-score[c], -sum(v == c for v in label.values()), c))
    members, groups = themes.grouped(entities, edges, least, keep)
    assert {r.entity_id: r.group_id for r in members.collect()} == {x: order.index(label[x]) for x in nodes}
    assert {r.group_id: r.score for r in groups.collect()} == {k: score[c] for k, c in enumerate(order)}
    assert themes.grouped(entities, edges, least, keep, 2)[1].count() == 2


def modularity(edges, label):
    total = 2 * sum(edges.values())
    degree, inside = {}, 0.0
    for (a, b), w in edges.items():
        degree[label[a]] = degree.get(label[a], 0) + w
        degree[label[b]] = degree.get(label[b], 0) + w
        inside += 2 * w * (label[a] == label[b])
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def test_communities_of_a_ring_of_cliques(spark):
    """Levels join what local moves leave apart: the best partition of small cliques in a ring pairs them."""
    size, cliques = 4, 12
    edges = {}
    for c in range(cliques):
        for a, b in itertools.combinations(range(size), 2):
            edges[c * size + a, c * size + b] = 1.0
        x, y = c * size, ((c + 1) % cliques) * size + 1
        edges[min(x, y), max(x, y)] = 1.0
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    label = {r.node: r.community for r in graph.louvain(frame, least=1).collect()}
    assert len(label) == size * cliques
    by_clique = {x: x // size for x in label}
    assert modularity(edges, label) >= modularity(edges, by_clique) - 1e-9
    assert all(label[c * size] == label[c * size + k] for c in range(cliques) for k in range(size))
    got = graph.modularity(frame, spark.createDataFrame(list(label.items()), "node long, community long"))
    assert abs(got - modularity(edges, label)) < 1e-9
    again = {r.node: r.community for r in graph.louvain(frame, least=1).collect()}
    assert again == label


def test_pairs_of_a_document_of_many_entities(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIR_BLOCK", 8)
    rnd = random.Random(1)
    rows = [(d, e, rnd.randrange(1, 5)) for d, n in ((1, 60), (2, 8), (3, 9), (4, 1)) for e in rnd.sample(range(100), n)]
    want = {}
    for (d, e, m), (d2, e2, m2) in itertools.combinations(sorted(rows), 2):
        if d == d2:
            c, n = want.get((e, e2), (0, 0))
            want[e, e2] = c + min(m, m2), n + 1
    got = {(r.src, r.dst): (r.co_count, r.co_docs) for r in graph.cooccurrence(spark.createDataFrame(rows, "doc_id long, entity_id long, mention_count long")).collect()}
    assert got == want


def test_empty_graphs(spark):
    edges = spark.createDataFrame([], "src long, dst long, weight double")
    assert themes.bridges(edges).count() == 0 and graph.louvain(edges).count() == 0
    entities = spark.createDataFrame([(1,), (2,)], "entity_id long")
    assert themes.grouped(entities, edges)[1].count() == 2


def test_alias_rules():
    assert merges.checked_rules([("a", "b"), ("c", "b")])
    for bad in ([("a", "b"), ("a", "c")], [("a", "b"), ("b", "c")]):
        with pytest.raises(ValueError):
            merges.checked_rules(bad)


def test_capped_entities_and_components(spark):
    rows = spark.createDataFrame([(1, e, e % 3) for e in range(10)], "doc_id long, entity_id long, mention_count long")
    assert [r.entity_id for r in graph.capped_entities(rows, 4).orderBy("entity_id").collect()] == [1, 2, 5, 8]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)], "src long, dst long")).collect()}
    assert {k: got[k] for k in (3, 4, 5, 8, 9)} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}


def test_fingerprint_ignores_the_order(spark):
    rows = [(1, 2, 0.5), (2, 3, 0.25), (1, 3, 0.125)]
    digest = lambda r: themes.fingerprint(spark.createDataFrame(r, "src long, dst long, weight double").repartition(3)).first()[0]
    assert digest(rows) == digest(rows[::-1]) != digest([*rows[:2], (1, 3, 0.126)])


def test_backlink_budget(spark):
    written = spark.createDataFrame([(k, 1) for k in range(2, 6)], "src long, dst long")
    derived = spark.createDataFrame([(1, 9), (1, 2)], "src long, dst long")
    got = [(r.source, r.kind) for r in links.backlinks(written, derived, 5).where("target = 1").orderBy("source").collect()]
    assert got == [(2, "written"), (3, "written"), (4, "written"), (5, "written"), (9, "derived")]


def test_spelling_ratio_of_nothing(spark):
    assert spark.createDataFrame([("", "")], "a string, b string").select(spelling_ratio(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_unchanged_graphs_are_not_built_again(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)], "src long, dst long, weight double")
    mark, found = themes.built(edges, None)
    assert found.count() == 3 and themes.built(edges, mark) == (mark, None)


def test_set_matches_take_the_best_pairs_first(spark):
    from granary.operators.evaluation import set_matches

    rnd = random.Random(4)
    sides = [{f"{side}{k}": set(rnd.sample(range(30), rnd.randrange(2, 9))) for k in range(8)} for side in "ab"]
    for k in range(4):
        sides[1][f"b{k}"] = set(sides[0][f"a{k}"]) | ({99} if k % 2 else set())
    pairs = sorted((-len(x & y) / len(x | y), a, b) for a, x in sides[0].items() for b, y in sides[1].items() if len(x & y) / len(x | y) >= 0.3)
    used, hits = set(), 0
    for _, a, b in pairs:
        if not {a, b} & used:
            used |= {a, b}
            hits += 1
    frames = [spark.createDataFrame([(s, m) for s, ms in side.items() for m in ms], "set_id string, member long") for side in sides]
    p, r = hits / 8, hits / 8
    got = set_matches(*frames, 0.3).first()
    assert (got.precision, got.recall) == (round(p, 6), round(r, 6)) and abs(got.f1 - p) < 1e-6
    assert tuple(set_matches(frames[0], frames[1].where("false")).first()) == (0.0, 0.0, 0.0)


def test_bridges_of_a_deep_path_and_random_graphs(spark):
    rng = random.Random(8)
    names = list(range(1, 301))
    rng.shuffle(names)
    path = list(zip(names, names[1:]))
    got = {(r.src, r.dst): tuple(sorted((r.below, r.beyond))) for r in themes.bridges(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert got == {(min(a, b), max(a, b)): tuple(sorted((k + 1, 299 - k))) for k, (a, b) in enumerate(path)}
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(38)] + [(100 + k, 101 + k) for k in range(9)] + [(5, 5), (3, 9), (9, 3)]
    pairs = {(min(e), max(e)): 1.0 for e in edges if e[0] != e[1]}
    got = {(r.src, r.dst): tuple(sorted((r.below, r.beyond))) for r in themes.bridges(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_bridges({x for e in pairs for x in e}, list(pairs)) and got
