"""URL models against dictionaries of counts."""

import collections
import math

import pytest
from granary.llm import url_filter
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(texts):
    """Log-ratio of each text's characters, as a mean: texts are (model text, kind), kind 1 rejected, 0 accepted, -1 neither."""
    fold = lambda t: ["\0"] * url_filter.ORDER + ["0" if c.isdigit() else c.lower() for c in t]
    seen = [collections.defaultdict(collections.Counter) for _ in range(2)]
    for text, kind in texts:
        if kind >= 0:
            s = fold(text)
            for i in range(url_filter.ORDER, len(s)):
                for k in range(url_filter.ORDER + 1):
                    seen[kind][tuple(s[i - k : i])][s[i]] += 1

    def p(kind, s, i):
        out = 1 / url_filter.ALPHABET
        for k in range(url_filter.ORDER + 1):
            after = seen[kind].get(tuple(s[i - k : i]))
            if after:
                c, d = sum(after.values()), len(after)
                out = (after[s[i]] + d * out) / (c + d)
        return out

    def score(text):
        s = fold(text)
        return sum(math.log(p(1, s, i)) - math.log(p(0, s, i)) for i in range(url_filter.ORDER, len(s))) / max(len(text), 1)

    return score


def model_texts(spark, pages, rules, seeds):
    """The texts and kinds that the operator's docstring says, from its own host, path and rule columns."""
    folds = {(r.page_id, r.url): r.f for r in pages.select("page_id", "url", F.pmod(F.xxhash64("url"), F.lit(4)).alias("f")).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    out = {}
    for r in url_filter.judge(pages, rules, seeds=seeds).collect():
        text = ".".join(r.host.split(".")[:-2]) + "/" + r.path
        words = "".join(c if c.isascii() and c.islower() else " " for c in r.host).split()
        if not r.host or folds[r.page_id, urls[r.page_id]] == 0:
            kind = -1
        elif r.rule:
            kind = int(not dict(rules)[r.rule])
        else:
            kind = int(any(w in seeds for w in words))
        out[r.page_id] = text, kind, r
    return out


@pytest.mark.parametrize("most_grams", [url_filter.MOST_GRAMS, 0])
def test_scores_match_counts_by_dictionary(spark, most_grams):
    rules = [url_filter.Rule("com/fr/", True), url_filter.Rule("com/de/", False)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(10_000, None), (10_001, "no host"), (10_002, "http://a.b.c.com/de/é?x"), (10_002, "http://a.b.c.com/de/é?x"), (10_003, "http://a.com"), (10_004, "http://" + "x" * 5000 + ".com/de/")], pages.schema)
    pages = pages.union(extra)
    told = model_texts(spark, pages.distinct(), rules, url_filter.SEEDS)
    texts = [told[r.page_id][:2] for r in pages.collect()]
    score = brute([(t.encode().decode("latin-1"), k) for t, k in texts])
    out = url_filter.judge(pages, rules, most_grams=most_grams).collect()
    assert len(out) == pages.count()
    for r in out:
        text = told[r.page_id][0].encode().decode("latin-1")
        assert abs(r.score - score(text)) < 1e-9 * max(1, abs(r.score)), r


def test_models_block_hosts_that_no_seed_names(spark):
    good = [f"http://{name}.news.net/story/{k}" for k in range(60) for name in ("river", "garden", "harbour", "meadow")]
    bad = [f"http://cheap-{name}.shop.net/buy/{k}" for k in range(60) for name in ("pills", "casino", "bets")]
    fold = F.pmod(F.xxhash64("url"), F.lit(4))
    names = [(f"http://cheap-{name}.shop.net/buy/{k}",) for k in range(20) for name in ("meds", "slots", "tabs")]
    fresh = [r.url for r in spark.createDataFrame(names, "url string").where(fold == 0).collect()]  # the models don't count these
    pages = spark.createDataFrame(list(enumerate(good + bad + fresh)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge(pages, []).collect()}
    assert all(out[k].verdict == "allow" for k in range(len(good)))
    assert all(out[k].verdict == "block" for k in range(len(good), len(out)))


def test_no_rejected_urls_block_nothing(spark):
    pages = spark.createDataFrame([(k, f"http://a{k}.net/x") for k in range(50)] + [(1, "http://a1.net/x")], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}
