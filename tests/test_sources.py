"""File sources and sinks, and functions that no query covers."""

import os
import re
import tempfile

import pytest
from granary.functions import text as tx
from granary.operators import records, review, search
from granary.plans import catalog
from granary.sources import files, shared
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def written(**named):
    path = tempfile.mkdtemp(prefix="granary-")
    for name, text in named.items():
        with open(os.path.join(path, name.replace("__", ".")), "w") as f:
            f.write(text)
    return path


def test_text_and_markdown_files(spark):
    path = written(a__txt="plain\ntext", b__md="---\ntitle: 'A note'\ntags: [x, \"y z\"]\n---\n# Head\nbody", c__md="---\ntags:\n  - p\n  - q\n---\nno heading", d__markdown="# Only heading\nx")
    assert [r.text for r in files.text_files(spark, path).collect()] == ["plain\ntext"]
    got = {os.path.basename(r.path): r for r in files.markdown_notes(spark, path).collect()}
    assert (got["b.md"].title, got["b.md"].tags, got["b.md"].body) == ("A note", ["x", "y z"], "# Head\nbody")
    assert (got["c.md"].title, got["c.md"].tags) == ("c", ["p", "q"])
    assert got["d.markdown"].title == "Only heading"


def test_readers_by_ending(spark):
    path = written(a__txt="one", b__md="# Two\nx")
    rows = {os.path.basename(r.path): r for r in files.read_folder(spark, path).collect()}
    assert rows["a.txt"].text == "one" and rows["b.md"].title == "Two"
    with pytest.raises(ValueError):
        files.register_reader((".md",), files.markdown_notes)


def test_csv_rows_archives_and_prune(spark):
    path = written(a__csv='h,i\n1,"x\ny"\n\n2,z\n', b__js='window.posts = [{"id": 1, "text": "a"}, {"id": 2, "text": null}]')
    assert files.csv_rows(spark, f"{path}/a.csv") == 2
    assert [tuple(r) for r in files.archive_posts(spark, path, "struct<id:long,text:string>").orderBy("id").collect()] == [(1, "a"), (2, None)]
    stored, listed = (spark.createDataFrame([(x,) for x in xs], "path string") for xs in ("abc", "bd"))
    assert sorted(r.path for r in files.prune_plan(stored, listed).collect()) == ["a", "c"]


def test_exported_notes_are_read_again(spark):
    out = tempfile.mkdtemp(prefix="granary-") + "/notes"
    docs = spark.createDataFrame([("s1", "Title\nof two", ["a", "b"], "body\nlines"), ("s2", "Other", [], "x")], "source string, title string, tags array<string>, text string")
    files.export_notes(docs, out)
    texts = {r.value for r in spark.read.option("lineSep", "\n␞\n").text(out).collect()}
    assert "---\ntitle: Title of two\ntags: [a, b]\n---\nbody\nlines" in texts and len(texts) == 2


def test_shared_folder_of_a_cluster_must_be_named():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_folder(Cluster())


def column(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(f(F.col("t"))).collect()]


def test_senders_names_and_durations(spark):
    assert column(spark, ["no_reply@x.org", "NoReply@x.org", "bounces+1@x.org", "robert@x.org", "abbot@x.org", "a@bot.org", "jane@x.org"], lambda c: tx.is_automated(c, ("jane@x.org",))) == [True, True, True, False, False, True, True]
    assert column(spark, ["Doe, Jane (Org)", "Jane Doe via List", "Jane"], tx.person_name) == ["Jane Doe", "Jane Doe", "Jane"]
    assert column(spark, ["2d", "3 h", "x", None], tx.duration_seconds) == [172800, 10800, None, None]


def test_dates(spark):
    got = column(spark, ["Tue, 2 Jan 2024 03:04:05 +0100", "2 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05", "2024-01-02T03:04:05+02:00", "2024-01-02", "never", "", None], tx.sent_at)
    assert [str(x) if x else None for x in got] == ["2024-01-02 02:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00", None, None, None]


def test_card_numbers_pass_the_luhn_sum(spark):
    def luhn(x):
        digits = [int(c) for c in x][::-1]
        return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0

    got = {r.doc_id: r.cards for r in catalog.queries()["card_numbers"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        found = [x for x in re.findall(r"(?<![0-9])[0-9]{13,19}(?![0-9])", r.text or "") if luhn(x)]
        if found:
            want[r.doc_id] = found
    assert got == want
    assert column(spark, ["4111111111111111 and ４１１１１１１１１１１１１１１１ 4111111111111112"], lambda c: tx.card_numbers(tx.folded_digits(c))) == [["4111111111111111"] * 2]


def test_sub_tokens_of_urls(spark):
    got = {r.page_id: r.parts for r in catalog.queries()["sub_tokens"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect():
        host = re.match(r"https?://([^\s/?#]+)", r.url)[1].lower()
        assert got[r.page_id] == list(dict.fromkeys(x for x in re.split(r"[@._%+:-]+", host) if len(x) >= 2 and x not in ("www", "com", "org", "net", "http", "https")))


def test_chunks_hold_every_word_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for r in records.chunked(docs, 60, 10).collect():
        rows.setdefault(r.doc_id, {})[r.chunk_index] = r
    for d in docs.collect():
        words, at = (d.text or "").split(), 0
        for k in range(len(rows.get(d.doc_id, {}))):
            chunk = rows[d.doc_id][k].content.split()
            assert len(chunk) <= 60 and rows[d.doc_id][k].tokens == len(chunk)
            lead = next(n for n in range(min(10, at) + 1) if chunk[n:] == words[at : at + len(chunk) - n] and chunk[:n] == words[at - n : at])
            at += len(chunk) - lead
        assert at == len(words)


def test_code_chunks_give_the_code_again(spark):
    code = "import x\n\ndef a():\n  return 1\nclass B:\n  pass\n" + "x\n" * 130
    got = column(spark, [code, "", "one"], tx.code_chunks)
    assert ["\n".join(c.code for c in chunks) for chunks in got] == [code, "", "one"]
    assert [c.first_line for c in got[0]] == [1, 3, 5, 65, 125]


def test_query_clusters_follow_their_order(spark):
    rows = spark.createDataFrame([("spark join", 9), ("spark join skew", 5), ("join skew", 4), ("other", 1)], "query string, n int")
    assert {r.query: r.seed for r in review.query_clusters(rows).collect()} == {"spark join": "spark join", "spark join skew": "spark join", "join skew": "join skew", "other": "other"}


def test_estimated_pairs_are_near_the_exact_ones(spark):
    exact = {(r.a, r.b): r.similarity for r in catalog.queries()["near_dup_exact"](spark, SF).collect()}
    guess = {(r.a, r.b): r.similarity for r in catalog.queries()["near_dup_estimated"](spark, SF).collect()}
    assert all(abs(guess[p] - exact[p]) < 0.16 for p in set(exact) & set(guess))
    assert {p for p, s in exact.items() if s >= 0.97} <= set(guess)


def test_modes_paraphrases_and_reach():
    assert tx.retrieval_mode("main themes of Jane Doe", ("Jane", "Jane Doe")) == ("themes", "Jane Doe")
    assert tx.retrieval_mode("an overview of everything") == ("global", None)
    assert tx.retrieval_mode("where is the joint", ("join",)) == ("local", None)
    assert tx.clean_paraphrases([" A b ", "a B", "orig", "c", "d"], "Orig") == ["A b", "c"]
    assert search.query_terms("The end, the END!") == (["the", "end"], "theend") and search.query_terms("one") == (["one"], None)
    assert search.engagement_reach(10) >= 10 and records.over_fetch(2000) == 17 and records.over_fetch(1) == 5 and records.over_fetch(10**6) == 50


def test_detectors_are_registered_once():
    with pytest.raises(ValueError):
        review.detector("failures")(lambda rows: rows)


def test_running_sums_over_one_hot_group(spark):
    from granary.operators import ranges

    rows = spark.createDataFrame([("hot", k, k % 5) for k in range(500)] + [("cold", 1, 2)], "g string, k long, v long")
    got = {(r.g, r.k): r.running for r in ranges.running(rows, ["g"], [F.col("k")], F.col("v")).collect()}
    assert got == {("hot", k): sum(x % 5 for x in range(k + 1)) for k in range(500)} | {("cold", 1): 2}
