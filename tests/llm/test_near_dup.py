import itertools
import random
import re

import pytest
from granary.llm import near_dup
from granary.llm.components import connected_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    label = {k: k for k in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    holds = {}
    for k, s in sets.items():
        for x in s:
            holds.setdefault(x, []).append(k)
    pairs = {p for ids in holds.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    return {(k, len(sets[k]), root(k), root(k) == k) for k in sets}


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r) for r in near_dup.near_duplicates(docs).collect()}


def test_planted_copies_chains_and_short_texts(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefg", k=4))
    rows, k = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "É x"), (7, "é x")], 10
    for size in (5, 9, 30, 120, 700):
        base = [word() for _ in range(size)]
        for copy in range(6):
            rows.append((k, " ".join(base)))
            k += 1
            base = list(base)
            for _ in range(max(1, size // 60)):
                base[rnd.randrange(size)] = word()
    passage = [word() for _ in range(60)]
    for _ in range(40):
        rows.append((k, " ".join([word() for _ in range(50)] + passage)))
        k += 1
    assert run(spark, rows) == brute(rows)


def test_one_large_group_near_the_threshold(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefg", k=4))
    base, rows = [word() for _ in range(120)], []
    for k in range(150):
        text = list(base)
        for _ in range(rnd.randrange(0, 9)):
            text[rnd.randrange(120)] = word()
        rows.append((k, " ".join(text)))
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == set()
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 3), (2, "a b c d e f", "y", 4)], "doc_id long, text string, id string, n int")
    assert {tuple(r) for r in near_dup.near_duplicates(docs).collect()} == {(1, 2, 1, True), (2, 2, 1, False)}


def test_documents_table_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 50, 359, 2000])
def test_registers_fill_and_estimate(n):
    import numpy as np

    rnd = np.random.default_rng(n)
    agree = []
    for _ in range(20):
        x = rnd.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = near_dup.registers(x[: n + n // 2]), near_dup.registers(x[n // 2 :])
        agree.append((a == b).mean())
        assert (near_dup.registers(x) == near_dup.registers(x[::-1].copy())).all()
    expected = (n + n // 2 - n // 2) / (2 * n)
    assert abs(np.mean(agree) - expected) < 0.25 / np.sqrt(min(n, 40))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (41, 42), (42, 40)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(100, 161)} == {100} and {out[k] for k in range(7, 40)} == {7} and {out[k] for k in (40, 41, 42)} == {40}
    assert 3 not in out
