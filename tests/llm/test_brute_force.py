"""Quality votes, toxic evidence, page differencing and the pipeline against plain Python over whole tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from granary.llm import html_text, quality, queries, toxicity
from pyspark.sql import functions as F

from .test_near_dup import brute as near_brute

SF = "/root/testdata/sf0.001"
SPACES = "[\t\n\v\f\r ]+"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ---- quality


def plain_votes(text):
    words = [w for w in re.split(SPACES, text) if w]
    n, symbols, stops = len(words), set("#$%&*@^~+=<>|\\_!?"), set(".,;:!?")
    small = lambda c: "a" <= c <= "z" or ord(c) >= 128
    upper = lambda c: "A" <= c <= "Z"
    shout = [sum(map(upper, w)) >= 2 and not any(map(small, w)) for w in words]
    stopped = [len(w.encode()) >= 2 and w[-1] in stops for w in words]
    share = lambda flags: sum(flags) / max(n, 1)
    low = [lower(w) for w in words]
    grams = [tuple(low[k : k + 5]) for k in range(n - 4)]
    lines = [x for x in lower(text).split("\n") if x]
    shares = {
        "symbols": share(len(w.encode()) >= 2 and w[-1] in symbols and w[-2] in symbols for w in words), "shouting": share(shout), "pipes": share(w == "|" for w in words), "echo": share(k > 0 and low[k] == low[k - 1] for k in range(n)),
        "repeats": 1 - len(set(grams)) / len(grams) if n >= 20 else 0.0, "lines": 1 - len(set(lines)) / len(lines) if n >= 20 and len(lines) >= 4 else 0.0,
        "function": share(all(map(small, w)) and len(w) <= 3 for w in words), "plain": share(all(small(c) or upper(c) for c in (w[:-1] if s else w)) and not x for w, s, x in zip(words, stopped, shout)),
    }
    votes, prose = {}, n > 0
    for name, (bad, fine) in quality.FAULTS.items():
        votes[name] = 0 if n >= 20 and shares[name] >= bad else -1
        prose = prose and shares[name] <= fine
    for name, (bad, good) in quality.WORDS.items():
        votes[name] = -1 if n < 20 else 1 if shares[name] >= good else 0 if shares[name] <= bad else -1
    votes |= {"prose": 1 if prose else -1, "words": 0 if n == 0 else -1}
    return sum((votes[v] + 1) * 3**k for k, v in enumerate(quality.VOTERS))


def test_votes_match_plain_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("wanted"))
    extra = spark.createDataFrame([(-1, None, False), (-2, " \n", False), (-3, "x y " * 5000, False), (-4, "É é ÉÉ\n" * 30, False), (-5, "| " * 40, False)], docs.schema)
    rows = docs.union(extra)
    got = {r.id: r.votes for r in quality._judged(rows).collect()}
    assert got == {r.id: plain_votes(r.text or "") for r in rows.collect()}


def test_expectation_maximisation_finds_the_accuracies():
    rnd = np.random.default_rng(5)
    n, right = 20_000, np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9])
    truth = rnd.random(n) < 0.8
    votes = np.where(rnd.random((n, 6)) < 0.4, -1, np.where(rnd.random((n, 6)) < right, truth[:, None], ~truth[:, None]).astype(int))
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model, posterior = quality.estimate(patterns, counts.astype(float))
    voted = (votes >= 0).sum(axis=1) >= 3
    assert ((posterior[where.ravel()] > 0.5) == truth)[voted].mean() > 0.93
    assert abs(model.good - 0.8) < 0.05
    for j in range(6):
        hit = model.table[j, 1, 2] / (model.table[j, 1, 1] + model.table[j, 1, 2])
        assert abs(hit - right[j]) < 0.08


# ---- toxicity


def test_scores_match_plain_evidence(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, found = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, labels).collect()}
    for r in found.collect():
        load, now, best, passages = math.log(model.scale * max(r.n, 1)), 0.0, 0.0, 0
        for k, s in enumerate(sorted((s.score for s in r.segments), reverse=True)):
            now += model.rate * s - load + math.log(k + 1)
            best = max(best, now)
        passages = sum(model.scale * max(r.n, 1) * math.exp(-model.rate * s.score) <= toxicity.MAX_E for s in r.segments)
        want = 1 / (1 + math.exp(-(model.slope * min(best, 100.0) + model.shift)))
        assert abs(got[r.id].score - want) < 1e-9 and len(got[r.id].passages) == passages


def test_log_odds_match_their_formula():
    seen, toxic, clean = np.array([100, 50, 5, 0]), np.array([9.0, 1.0, 0.0, 0.0]), np.array([1.0, 20.0, 2.0, 0.0])
    delta, z = toxicity.log_odds(seen, toxic, clean, 10.0, 30.0)
    prior = [(0.5 if s else 0.0) + toxicity.PRIOR_WEIGHT * s / 155 for s in seen]
    a, b = [t + p + 1e-9 for t, p in zip(toxic, prior)], [c + p + 1e-9 for c, p in zip(clean, prior)]
    for k in range(4):
        assert abs(delta[k] - (math.log(a[k] / sum(a)) - math.log(b[k] / sum(b)))) < 1e-9
        table = [[toxic[k], 10 - toxic[k]], [clean[k], 30 - clean[k]]]
        g = 2 * sum(o * math.log(o * 40 / (sum(row) * (toxic[k] + clean[k] if c == 0 else 40 - toxic[k] - clean[k]))) for row in table for c, o in enumerate(row) if o > 0)
        assert abs(z[k] - math.copysign(math.sqrt(max(g, 0)), delta[k])) < 1e-6


# ---- pages


def plain_differencing(rows):
    found = {k: html_text.lines(h) for k, _, h in rows}
    parts = {k: (lower(re.match(r"[^/?#]*", u.split("://", 1)[1])[0]), re.match(r"[^/?#]*([^?#]*)", u.split("://", 1)[1])[1]) for k, u, _ in rows}
    order = sorted(parts, key=lambda k: (*parts[k], k))
    told = lambda k: ([html_text.line_hash(x.text) for x in found[k]], [len(x.text) for x in found[k]])
    same = lambda a, b: parts[a][0] == parts[b][0]
    run, number = {}, 0
    for before, k in zip([None, *order], order):
        number += not (before is not None and same(before, k) and html_text.shared_of_different(*told(k), *told(before)) is None)
        run[k] = number
    shared = {}
    for place, k in enumerate(order):
        first = next(x for x in range(place, -1, -1) if x == 0 or run[order[x - 1]] != run[k])
        last = next(x for x in range(place, len(order)) if x == len(order) - 1 or run[order[x + 1]] != run[k])
        near = [order[x] for x in (first - 1, last + 1) if 0 <= x < len(order) and same(order[x], k)]
        if near and found[k]:
            shared[k] = {p for o in near for p in html_text.shared_of_different(*told(k), *told(o)) or ()}
    rate = collections.defaultdict(list)
    for k, hits in shared.items():
        for p, x in enumerate(found[k]):
            if x.main:
                rate[parts[k][0], x.path].append((p in hits, k))
    template = {key for key, seen in rate.items() if sum(h for h, _ in seen) / len(seen) >= html_text.RATE and len({k for _, k in seen}) >= html_text.PAGES}
    out = {}
    for k, x in found.items():
        gone = [p for p in shared.get(k, ()) if not x[p].main or (parts[k][0], x[p].path) in template]
        out[k] = html_text.text_of(x, gone)
    return out


def test_main_text_matches_plain_differencing(spark):
    rnd, rows = random.Random(12), []
    words = lambda n: " ".join(rnd.choice("alpha beta gamma delta omega zeta kappa sigma".split()) for _ in range(n))
    for host in range(4):
        bars, bodies = [words(4) for _ in range(3)], [[words(12) for _ in range(rnd.randrange(2, 7))] for _ in range(12)]
        for k in range(30):
            body = list(rnd.choice(bodies))
            if rnd.random() < 0.4:
                body[rnd.randrange(len(body))] = words(9)
            marked = host % 2 == 0 or k % 5 == 0
            paragraphs = "".join(f"<p>{x}</p>" for x in body)
            bar = f"<div class='q{k}'>{bars[2]}</div>" if host != 2 or k % 3 else ""
            inner = f"<article><h2>{words(3)}</h2>{bar}{paragraphs}</article>" if marked else f"{bar}{paragraphs}"
            rows.append((len(rows), f"http://h{host}.org/s{rnd.randrange(5)}/{k}", f"<body><div>{bars[0]}</div><nav>{words(2)}</nav>{inner}<div>{bars[1]}</div></body>"))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = plain_differencing(rows)
    assert got == want
    without = {k: html_text.text_of(html_text.lines(h), None) for k, _, h in rows}
    assert sum(want[k] != without[k] for k in want) > 50


# ---- pipeline


def plain_coverage(text, item, least=5):
    """Greedy tiling by whole scans."""
    free_t, free_i, covered = [True] * len(text), [True] * len(item), 0
    at = collections.defaultdict(list)
    for b in range(len(item) - least + 1):
        at[tuple(item[b : b + least])].append(b)
    if not any(tuple(text[a : a + least]) in at for a in range(len(text) - least + 1)):
        return 0
    while True:
        best = None
        for a in range(len(text) - least + 1):
            for b in at.get(tuple(text[a : a + least]), ()):
                n = 0
                while a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n] and free_t[a + n] and free_i[b + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, a, b
        if best is None:
            return covered
        n, a, b = best
        free_t[a : a + n], free_i[b : b + n] = [False] * n, [False] * n
        covered += n


def test_pipeline_stages_match_plain_ones(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = lambda d: {r.doc_id: r for r in d.collect()}
    whole = columns(docs)
    kept = stage["quality classifier"](spark, docs, SF).cache()
    judged = {r.doc_id: r.kept for r in queries.op3_weak_labels(spark, SF).collect()}
    assert columns(kept) == {k: r for k, r in whole.items() if judged[k]}
    once = stage["near duplicates"](spark, kept, SF).cache()
    assert columns(once) == {k: whole[k] for k, _, _, first in near_brute([(r.doc_id, r.text) for r in kept.collect()]) if first}
    clean = stage["benchmark decontamination"](spark, once, SF).cache()
    words = lambda t: [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", lower(t or "")) if w]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in once.collect() if any(len(i) >= 5 and plain_coverage(words(r.text), i) >= 0.5 * len(i) for i in items)}
    assert columns(clean) == {k: r for k, r in columns(once).items() if k not in dirty}
    safe = stage["secret scan"](spark, clean, SF).cache()
    assert columns(safe).keys() == columns(clean).keys()
    for k, r in columns(safe).items():
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (whole[k].lang, whole[k].source)
        assert not re.search(r"AKIA[A-Z0-9]{16}", r.text)
        plain = whole[k].text.split("\n")
        assert r.text == whole[k].text or "<secret>" in r.text
        assert [x for x in r.text.split("\n") if "<secret>" not in x] == [x for x in plain if x in r.text.split("\n")] or "<secret>" in r.text
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 0] for r in safe.collect()}
    seen = collections.defaultdict(int)
    for p in stage["packing"](spark, safe, SF).collect():
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        seen[p.doc_id] += p.length
    assert seen == {k: len(x) for k, x in ids.items()}


@pytest.mark.parametrize("name", ["quality classifier", "near duplicates", "benchmark decontamination", "secret scan", "packing"])
def test_pipeline_stages_take_edge_rows(spark, name):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 20_000, "en", "s", 100_000), (None, "no id but some text of its own", "en", "s", 30), (4, "the same text of ordinary words", "en", "s", 5), (4, "the same text of ordinary words", "en", "s", 5)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        out.collect()
        if name != "packing":
            assert out.columns == docs.columns
