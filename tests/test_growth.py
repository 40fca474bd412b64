"""What queries exchange and keep grows with their input."""

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granary.functions import stemming
from granary.functions.text import tokens
from granary.operators import graph, links, merges, near_dup_store, packed, review, search, similarity
from granary.plans import catalog
from granary.sources import shared, tables

SF = "/root/testdata/sf0.001"


def test_names_are_found_without_sending_texts_on(spark):
    rows = spark.createDataFrame([(1, "Ann met BOB and bob"), (2, None), (3, "a b")], "doc_id long, text string")
    names = F.concat(tokens(F.col("text")), F.array(F.lit("ann met"), F.lit("Bo"), F.lit("zoe"), F.lit(None)))
    found = merges.present(rows, "text", names)
    assert found.columns == ["doc_id", "name"]
    assert sorted(map(tuple, found.collect())) == [(1, "Bo"), (1, "and"), (1, "ann"), (1, "ann met"), (1, "bob"), (1, "bob"), (1, "met"), (3, "a"), (3, "b")]
    plan = catalog.queries()["entity_finalise"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(text" not in plan


def test_graph_build_reads_its_texts_once(spark):
    assert not [f for f in catalog.queries()["graph_build"](spark, SF).inputFiles() if "documents.parquet" in f]


def test_packed_postings_hold_each_word_once_a_stretch(spark):
    texts = [(1, ["a", "b", "a"]), (2, None), (3, []), (4, ["b", "c", "b", "a"])]
    rows = spark.createDataFrame(texts, "id long, words array<string>").coalesce(1)
    plain = sorted((w, k, words.count(w), [i + 1 for i, x in enumerate(words) if x == w]) for k, words in texts for w in set(words or []))
    held = packed.packed(rows, "words", positions=True)
    assert held.count() == held.select("word").distinct().count() == 3
    assert sorted((r.word, r.id, r.tf, r.positions) for r in packed.unpacked(held, ["id"], "word").collect()) == plain
    counts = packed.unpacked(packed.packed(rows, "words"), ["id"], "word").collect()
    assert sorted((r.word, r.id, r.tf) for r in counts) == [x[:3] for x in plain]


def test_stems_of_words_that_no_step_changes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ends = [*stemming.SECOND, *stemming.THIRD, *stemming.FOURTH, "eed", "eedly", "edly", "ed", "ing", "ingly", "sses", "ied", "ies", "us", "y", "ey", "ll", "e", "'s", "", "k", "o", "n", "t", "r"]
    words = {"".join(rng.choice(list("abceilnorstuy'"), rng.integers(1, 7))) + e for e in ends for _ in range(30)} | {*stemming.LEFT_ALONE, *stemming.OWN_STEMS, "yoyo", "enjoyhook", "straße", "b2b"}
    rows = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,)], "word string")
    told = lambda: {r.word: r.stem for r in stemming.with_stems(rows).collect()}
    plan = stemming.with_stems(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert stemming.CHANGED[:20] in plan
    found = told()
    assert found["yoyo"] == "yoyo" and found["enjoyhook"] == "enjoyhook" and found[None] is None
    monkeypatch.setattr(stemming, "CHANGED", "")
    assert found == told()


def test_stretches_lose_no_text(monkeypatch):
    monkeypatch.setattr(packed, "WORDS", 5)
    sizes = [0, 3, 2, 9, 0, 1, 1, 4, 0]
    column = pa.array([list("x" * n) if n else None for n in sizes], pa.list_(pa.string()))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), column[a:b]], ["id", "words"]) for a, b in ((0, 4), (4, 9))]
    out = list(packed._stretches(iter(batches), "words"))
    assert sum((t["id"].to_pylist() for t in out), []) == list(range(9))
    held = [[len(w or []) for w in t["words"].to_pylist()] for t in out]
    assert len(held) > 2 and all(sum(x) <= 5 or sum(map(bool, x)) == 1 for x in held)


def _aggregates(df):
    """The aggregates of a plan, each of which exchanges its rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Aggregate [" in x]


def test_pairs_of_participants_are_not_exchanged(spark):
    rows = [(1, ["B", "a"]), (20, ["a", "b"]), (40, ["b"]), (3, ["c"]), (60, ["c", "b", "c"])]
    keys = links.participant_keys(spark.createDataFrame(rows, "doc_id long, participants array<string>"))
    touched = keys.where("doc_id % 20 = 0")
    found = links.shared_participant(touched, keys)
    sets = {k: {p.lower() for p in ps} for k, ps in rows}
    plain = [(a, b, min(sets[a] & sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b] and (a % 20 == 0 or b % 20 == 0)]
    assert sorted(map(tuple, found.collect())) == sorted(plain)
    assert not [x for x in _aggregates(found) if "src" in x]
    days = spark.createDataFrame([(k, date(2024, 1, 1 + k % 7)) for k in sets], "doc_id long, day date")
    ruled = links.ruled_participant(touched, keys, days).collect()
    assert sorted(map(tuple, ruled)) == sorted(("same_day" if abs(a % 7 - b % 7) <= 1 else "participant", a, b, e) for a, b, e, _ in plain)
    assert not [x for x in _aggregates(catalog.queries()["rule_precedence"](spark, SF)) if "src" in x]


def _random_sets(n):
    rng = np.random.default_rng(6)
    return {k: {"hot", *(f"p{x}" for x in rng.integers(0, 9, 2))} if k % 3 else {f"p{x}" for x in rng.integers(0, 9, k % 4)} for k in range(n)}


def test_common_keys_are_found_once_a_pair_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(links, "CHUNK", 3)
    monkeypatch.setattr(links, "PART_DOCS", 20)
    sets = _random_sets(130)
    keys = spark.createDataFrame([(d, x) for d, ks in sets.items() for x in ks], "doc_id long, key string")
    common = {(a, b): sets[a] & sets[b] for a in sets for b in sets if a < b and sets[a] & sets[b]}
    for touched, asked in ((keys.where("doc_id % 20 = 0"), lambda d: d % 20 == 0), (None, lambda d: True)):
        found = links.shared_participant(touched, keys)
        want = [(a, b, min(c), len(c)) for (a, b), c in common.items() if asked(a) or asked(b)]
        assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 300
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # a join of chunks, and documents only come out of them
        assert plan.index("posexplode(y_docs") < plan.index("Join Inner")


def test_rule_precedence_covers_all_documents(spark, monkeypatch):
    monkeypatch.setattr(links, "CHUNK", 3)
    notes = tables.notes(spark, SF).select("doc_id", "participants", F.to_date("doc_date").alias("day")).collect()
    sets, day = {r.doc_id: {x.lower() for x in r.participants} - {""} for r in notes}, {r.doc_id: r.day for r in notes}
    want = {(a, b): ("same_day" if abs((day[a] - day[b]).days) <= 1 else "participant", min(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    found = catalog.queries()["rule_precedence"](spark, SF).collect()
    assert {(r.src, r.dst): (r.rule, r.evidence) for r in found} == want and len(found) == len(want)
    assert [1 for a, b in want if a % 20 and b % 20] and "% 20" not in catalog.oracle_sql()["rule_precedence"]


def test_cosines_of_asked_rows_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 3)
    monkeypatch.setattr(similarity, "PART_BYTES", 100)
    v = np.random.default_rng(1).normal(size=(60, 4)).round(3)
    v[7] = v[20] = 0
    rows = [(k, [float(x) for x in v[k]], None if k % 11 == 0 else k % 2) for k in range(60)]
    data = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    plain = {(a, b): round(float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])), 6) for a, _, x in rows for b, _, y in rows if a % 5 == 0 and a != b and x is not None and x == y and v[a].any() and v[b].any()}
    found = similarity.cosine_to(data.where("id % 5 = 0"), data, "label", 0.2).collect()
    assert {(r.a, r.b): r.cosine for r in found} == {k: c for k, c in plain.items() if c >= 0.2} and len(found) > 50


def test_titles_that_share_words_are_counted_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD_WORDS", 40)
    monkeypatch.setattr(search, "ASKED_TITLES", 2)
    rng = np.random.default_rng(5)
    sets = {k: {f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 9))} | ({"all"} if k % 2 else set()) for k in range(90)}
    titles = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "doc_id long, words array<string>")
    none = spark.createDataFrame([], "query_id long, id long, rank int")
    found = search.related(titles.where("doc_id % 20 = 0"), titles, none, 0.3, 4, 0.0)
    often = {w for w in set().union(*sets.values()) if sum(w in v for v in sets.values()) > 27}
    assert often
    want = []
    for a in range(0, 90, 20):
        shared = sorted((-len((sets[a] & sets[b]) - often), b) for b in sets if b != a and (sets[a] & sets[b]) - often)
        want += [(a, b, round(1 / (61 + k), 9)) for k, (_, b) in enumerate(shared[:4])]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 12
    assert "count(1) AS n" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_exact_pairs_exchange_prefixes_alone(spark, monkeypatch):
    monkeypatch.setattr(similarity, "STRETCH", 500)
    rng = np.random.default_rng(8)
    base = [list(range(1000 * k, 1000 * k + 60)) for k in range(6)]
    sets = {k: sorted({*(x if rng.random() > 0.04 else int(rng.integers(9000, 9999)) for x in base[k % 6]), *range(50_000, 50_020)}) for k in range(60)} | {70: [], 71: [5]}
    frame = spark.createDataFrame(list(sets.items()), "doc_id long, shingles array<long>")
    often = similarity.frequent_shingles(frame)
    assert set(range(50_000, 50_020)) <= set(often.tolist())
    rows = similarity.prefixes(frame, 0.85, often)
    assert rows.count() < sum(map(len, sets.values())) / 5 and not rows.where("shingle >= 50000").count()
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in ((k, set(v)) for k, v in sets.items()) for b, y in ((k, set(v)) for k, v in sets.items()) if a < b and x | y}
    want = {k: s for k, s in want.items() if s >= 0.85}
    assert {(r.a, r.b): r.similarity for r in similarity.exact_pairs(frame, 0.85).collect()} == want and len(want) > 30


def test_near_dup_state_writes_each_set_once(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 3, 80)), "t") for k in range(9)] + [(9, "short", "t")], "doc_id long, text string, thread string")
    state = near_dup_store.started(spark)
    near_dup_store.updated(state, docs)
    near_dup_store.updated(state, docs.withColumn("text", F.when(F.col("doc_id") == 4, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))))
    sets = spark.read.parquet(f"{state.folder}/sets")
    assert sorted((r.segment, r.doc_id) for r in sets.collect()) == [(1, k) for k in range(10)] + [(2, 4)]
    bands = spark.read.parquet(f"{state.folder}/bands")
    assert {len(r["class"]) for r in bands.collect()} == {16} and bands.count() == 4 * similarity.BANDS
    assert near_dup_store.listing(state)[1].count() == 9


def test_near_dup_state_stores_no_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup_store, "HELD", 2)
    monkeypatch.setattr(near_dup_store, "AT_ONCE", 3)
    text = lambda k: " ".join(f"w{j}" if j != 7 * k else f"own{k}" for j in range(240))
    frame = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string").withColumn("thread", F.lit(None).cast("string"))
    texts = {k: text(k) for k in range(12)} | {12: text(3), 13: "short"}
    state = near_dup_store.started(spark)
    near_dup_store.updated(state, frame(texts))
    pairs = lambda: sorted(map(tuple, near_dup_store.listing(state)[0].collect()))
    sets = {k: {tuple(t.split()[j : j + 5]) for j in range(236)} for k, t in texts.items() if k < 12}
    want = [(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b]
    want = [p for p in want if p[2] >= 0.85]
    assert pairs() == want and len(want) > 20
    stored = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{state.folder}/sets").schema}
    assert "shingles" not in stored and stored["bands"] == "array<bigint>"
    # a class whose texts are gone for an update, while others came, is found again when they are back
    near_dup_store.updated(state, frame({k: t for k, t in texts.items() if k not in (2, 5)}))
    assert pairs() == [p for p in want if not {2, 5} & {*p[:2]}]
    near_dup_store.updated(state, frame({k: t for k, t in texts.items() if k not in (2, 4)}))
    assert pairs() == [p for p in want if not {2, 4} & {*p[:2]}]
    near_dup_store.updated(state, frame(texts))
    assert pairs() == want


def test_tasks_of_mentions_grow_with_their_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    found = tables.mentions_by_document(spark, SF)
    assert found.rdd.getNumPartitions() >= 60
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, tables.mentions(spark, SF).collect()))
    assert catalog.queries()["document_rewrite"](spark, SF).rdd.getNumPartitions() >= 60


def test_communities_count_an_edge_once_without_a_distinct(spark):
    labels = {1: "a", 2: "a", 3: "b"}
    edges = [(1, 1, 2, 5), (1, 1, 3, 7), (1, 3, 9, 2), (2, 1, 2, 5), (3, 8, 9, 4), (4, 1, 2, 100)]
    found = review.community_weight(spark.createDataFrame(list(labels.items()), "node long, community string"), spark.createDataFrame(edges, "doc_id long, src long, dst long, n long"), spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), 5)
    assert [tuple(r) for r in found.collect()] == [("a", 17), ("b", 9)]
    assert not [x for x in _aggregates(found) if "src" in x and "dst" in x]


def test_components_of_repeated_edges_make_nothing_distinct(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 3)
    edges = spark.createDataFrame([(5, 4), (4, 5), (5, 4), (4, 3), (9, 8), (7, 7)], "src long, dst long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {3: 3, 4: 3, 5: 3, 7: 7, 8: 8, 9: 8}
    assert graph.tasks_for(100, spark) == 34


def test_affinity_by_pairs_of_entities(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = {k: {int(x) for x in rng.integers(0, 9, rng.integers(1, 5))} for k in range(60)}
    mentions = spark.createDataFrame([(k, e, 1) for k, v in docs.items() for e in v], "doc_id long, entity_id long, mention_count int")
    made = []
    monkeypatch.setattr(graph, "contributions", lambda m, f=graph.contributions: made.append(1) or f(m))
    for least in (1, 2, 3):
        want = {(a, b): (n, round(n / min(len(docs[a]), len(docs[b])), 6)) for a in docs for b in docs if a < b and (n := len(docs[a] & docs[b])) >= least}
        assert {(r.a, r.b): (r.shared, r.affinity) for r in graph.affinity(mentions, least).collect()} == want and want
    assert len(made) == 5  # by entities, then twice by their pairs
