"""Stems, the stored fielded index, the vector index and the stored near-duplicate state against plain Python."""

import random
import re
import tempfile

import numpy as np
import pytest
from granary.functions import stemming
from granary.operators import lexical_index, links, near_dup_store, ranges, review, search, similarity, vector_index
from granary.sources import shared
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: Words of the stemmer's published sample and their stems, and some cases of each rule.
PAIRS = """consign consign consigned consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori consolingly consol
conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knaves knave knavish knavish kneading knead kneeled kneel knees knee
knightly knight knitted knit knives knive knocker knocker provisioning provis databases databas responses respons decisions decis happy happi generously generous generate generat generic generic
communication communic hoping hope hopped hop falling fall relational relat conditional condit rational ration valency valenc digitizer digit vietnamization vietnam operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous sensitivity sensit sensibility sensibl triplicate triplic formative format formalize formal electrical electr goodness good revival reviv
allowance allow inference infer adjustable adjust defensible defens replacement replac adjustment adjust dependent depend adoption adopt communism communism activate activ probate probat rate rate
cease ceas controlling control skies sky dying die news news innings inning proceed proceed exceeded exceed youth youth sayings say by by cry cri flies fli ties tie gas gas this this kiwis kiwi
bed bed bedded bed shed shed luxuriated luxuri agreed agre feed feed fizzed fizz toy toy enjoy enjoy analogies analog really realli fluently fluentli x x 42nd 42nd été été dog's dog""".split()


def test_stems_of_known_words(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2]))
    rows = spark.createDataFrame([(w, k) for k, (w, _) in enumerate(pairs)] + [(None, -1)], "word string, done int")
    out = {r.word: r.stem for r in stemming.with_stems(rows).collect()}
    assert {w: out[w] for w, _ in pairs} == dict(pairs)
    assert out[None] is None
    assert stemming.with_stems(rows.where("false")).count() == 0


def test_lexemes_leave_out_stop_words(spark):
    words = spark.createDataFrame([("the",), ("running",), ("runs",), ("running",), (None,)], "word string")
    assert sorted(map(tuple, stemming.lexemes(words).collect())) == [("running", "run"), ("runs", "run")]


DOCS = [(1, "Running dogs", "pets en", "The dog runs. The dogs ran home"), (2, "Cats", "pets", "A cat sat on the mat"), (3, None, None, None), (4, "", "", "dog of home and dog of homes"), (5, "Home page", "homepage", "homepage")]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, tags string, content string")


def held(index, text, **more):
    return {r.doc_id: r.score for r in lexical_index.scores(index, text, **more).collect()}


@pytest.fixture
def index(spark):
    new = lexical_index.TextIndex(spark, shared.folder_for(spark, "text-index"), ["doc_id"], ["title", "tags", "content"])
    lexical_index.updated(new, table_of(spark, DOCS))
    return new


def test_stemmed_search_over_fields(spark, index):
    assert held(index, "dogs running!") == {1: round(1.0 * (1 / 2 + 1 / 2) + 0.2 * (2 / 3 + 1 / 2), 6)}
    assert set(held(index, "home page")) == {5}  # both words, and the compact spelling
    assert set(held(index, "The DOG")) == {1, 4}
    assert held(index, "the of") == held(index, "") == held(index, "!!") == held(index, "nowhere dog") == {}


def test_phrases_keep_places_of_stop_words(spark, index):
    found = lambda text: {(r.doc_id, r.field): r.n for r in lexical_index.phrases(index, text).collect()}
    assert found("dog of home") == {(4, "content"): 2, (1, "content"): 1}  # "dogs ran home" too
    assert found("dog home") == {}
    assert found("running dog") == {(1, "title"): 1}
    assert found("the") == {}


def test_index_follows_changes(spark, index, monkeypatch):
    now = [r for r in DOCS if r[0] != 2] + [(6, "Zebra dogs", "zoo", "zebra")]
    now[0] = (1, "Birds", "pets en", "a bird")
    assert lexical_index.updated(index, table_of(spark, now)) == 2
    assert set(held(index, "dog")) == {4, 6} and set(held(index, "bird")) == {1} and held(index, "cat") == {}
    assert lexical_index.updated(index, table_of(spark, now)) == 0 and index.segments == 2
    monkeypatch.setattr(lexical_index, "MOST_SEGMENTS", 2)
    assert lexical_index.updated(index, table_of(spark, DOCS)) == 2  # the first text of 1, and 2
    assert index.segments == 1
    assert set(held(index, "dog")) == {1, 4} and set(held(index, "cat")) == {2} and held(index, "zebra") == {}


def test_a_rewritten_table_is_seen(spark):
    path = "file://" + tempfile.mkdtemp(prefix="granary-") + "/t"
    for rows in (DOCS, [(9, "Other dogs", "", "")]):
        table_of(spark, rows).write.mode("overwrite").parquet(path)
        frame = spark.read.parquet(path)
        index = lexical_index.current(frame, path, ["doc_id"], ["title", "tags", "content"])
        assert set(held(index, "dogs")) == {r[0] for r in rows if "dog" in " ".join(x or "" for x in r[1:])}
        old = search.stored_index(search.chunks(frame, text_col="title"), ["doc_id"], "content", path)
        assert {r.doc_id for r in old.collect()} == {r[0] for r in rows if r[1]}


def test_postings_read_their_folders_only(spark, index):
    plan = lexical_index.postings_of(index, ["dog"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: [" in plan
    assert spark.sql("SELECT pmod(xxhash64('dog'), 64)").first()[0] == lexical_index.bucket_of("dog")


def test_bucket_of_index_terms(spark):
    import xxhash

    words = ["a", "the", "été", "日本", "x" * 300, ""]
    out = spark.createDataFrame([(w,) for w in words], "w string").select(search.term_bucket(F.col("w")).alias("b")).collect()
    assert [r.b for r in out] == [xxhash.xxh64_intdigest(w.encode(), 42) % search.BUCKETS for w in words]


def clustered(spark, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + 0.25 * rng.normal(size=16)).tolist()) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (-1, None), (-2, [0.0] * 16)], "id long, vector array<double>")


def test_adaptive_search_is_exact_and_reads_few_cells(spark):
    rows, frame = clustered(spark)
    queries = frame.where("id % 50 = 0 and id >= 0")
    index = vector_index.built(frame, 30)
    exact = {(r.query_id, r["rank"]): (r.id, r.score) for r in search.nearest_neighbours(queries, frame.where("id >= 0"), 4, 0.5).collect()}
    out = vector_index.adaptive(index, queries, 4, 0.5).collect()
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in out} == exact
    probes = vector_index._ordered(index, queries)
    assert probes.where("bound >= 0.5").count() < 0.5 * probes.count()  # the rest can't hold anything


def test_approximate_search_has_recall(spark):
    rows, frame = clustered(spark)
    queries = frame.where("id % 50 = 0 and id >= 0")
    near = {(r.query_id, r.id) for r in vector_index.approximate(vector_index.built(frame, 30), queries, 5, 3).collect()}
    exact = {(r.query_id, r.id) for r in search.nearest_neighbours(queries, frame.where("id >= 0"), 5).collect()}
    assert len(near & exact) >= 0.95 * len(exact)


def test_approximate_query_has_recall_on_the_given_vectors(spark):
    from granary.plans import catalog

    pairs = lambda name: {(r.query_id, r.id) for r in catalog.queries()[name](spark, SF).collect()}
    exact = pairs("knn_join")
    assert len(exact & pairs("approximate_neighbours")) >= 0.9 * len(exact)


def test_vector_index_of_few_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    assert vector_index.adaptive(vector_index.built(frame), frame, 3).count() == 0
    asked = spark.createDataFrame([(2, [1.0, 1.0])], "id long, vector array<double>")
    assert [(r.id, r.score) for r in vector_index.adaptive(vector_index.built(frame), asked, 3).collect()] == [(1, 0.707107)]


def test_near_dup_state_equals_a_full_run(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    base = [words(120) for _ in range(12)]
    texts = {}
    for k in range(60):
        own = list(base[k % 12])
        if k >= 12 and k % 3:
            own[rng.randrange(120)] = "changed"
        texts[k] = " ".join(own)
    texts |= {60: "short text", 61: None, 62: ""}
    frame = lambda t: spark.createDataFrame([(k, x, f"t{k % 5}" if k % 7 else None) for k, x in t.items()], "doc_id long, text string, thread string")

    def told(state):
        pairs, own = near_dup_store.listing(state)
        return sorted(map(tuple, pairs.collect())), sorted(map(tuple, own.select("doc_id", "class_id").collect()))

    whole = near_dup_store.started(spark)
    near_dup_store.updated(whole, frame(texts))
    step = near_dup_store.started(spark)
    near_dup_store.updated(step, frame({k: (x if k % 9 else " ".join(words(80))) for k, x in texts.items() if k != 5} | {99: texts[1]}))
    counts = near_dup_store.updated(step, frame(texts))
    assert counts["texts"] <= 8 and told(step) == told(whole)
    assert near_dup_store.updated(step, frame(texts)) == {"texts": 0, "classes": 0} and told(step) == told(whole)
    sets, members = similarity.classes(similarity.shingled(frame(texts)))
    classes = {r.doc_id: r.class_id for r in members.collect()}
    assert told(whole)[1] == sorted(classes.items())
    threads = {}
    for k, c in classes.items():
        threads.setdefault(c, set()).add(f"t{k % 5}" if k % 7 else k)
    full = [(r.a, r.b, r.similarity) for r in similarity.exact_pairs(sets, 0.85).collect()]
    assert told(whole)[0] == sorted(p for p in full if len(threads[p[0]] | threads[p[1]]) > 1)


def test_query_clusters_equal_the_sequential_rule(spark):
    rng = random.Random(12)
    queries = sorted({" ".join(rng.sample("alpha beta gamma delta eps zeta eta".split(), rng.randrange(1, 5))) for _ in range(120)})
    rows = [(q, rng.randrange(1, 6)) for q in queries]
    seeds, want = [], {}
    for q, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        words = set(q.split())
        seed = next((s for s, w in seeds if len(w & words) / len(w | words) >= 0.5), q)
        if seed == q:
            seeds.append((q, words))
        want[q] = seed
    assert {r.query: r.seed for r in review.query_clusters(spark.createDataFrame(rows, "query string, n int")).collect()} == want
    assert review.query_clusters(spark.createDataFrame([], "query string, n int")).count() == 0


def test_percentiles_are_those_of_sorted_values(spark):
    rng = random.Random(3)
    rows = [(k % 3, float(rng.randrange(50)) if k % 11 else None) for k in range(500)] + [(9, 1.5), (10, None)]
    got = {r.g: (r.low, r.mid, r.high) for r in ranges.percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"low": 0.0, "mid": 0.5, "high": 0.95}).collect()}
    for g in (0, 1, 2, 9):
        values = sorted(v for k, v in rows if k == g and v is not None)
        at = lambda share: values[max(1, -int(-len(values) * share // 1)) - 1]  # noqa: E731, B023
        assert got[g] == (at(0.0), at(0.5), at(0.95))
    assert set(got) == {0, 1, 2, 9}


def test_split_joins_lose_no_pair(spark):
    docs = spark.createDataFrame([(k, "hot" if k % 2 else f"key{k % 5}") for k in range(200)], "doc_id long, thread_id string")
    touched = docs.where("doc_id % 20 = 1")
    got = {(r.src, r.dst) for r in links.shared_thread(touched, docs).collect()}
    assert got == {(min(a, b), max(a, b)) for a in range(1, 200, 20) for b in range(1, 200, 2) if a != b}
