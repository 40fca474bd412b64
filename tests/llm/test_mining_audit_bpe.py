"""Hard negatives, filter audit and byte-level BPE against plain Python, with edge rows."""

import hashlib
import itertools
import math
import random
import re
import struct
import tempfile

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from granary.llm import byte_bpe, filter_audit, hard_negatives
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain_negatives(rows):
    """``(anchor, positive, rank, negative, positive score, negative score)`` by all scores; rows are id, label, vector."""
    held = {}
    for key, label, vector in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held[key] = min(held.get(key, (label, vector)), (label, vector))
    whole = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in held.items()}
    out = []
    for a in sorted(whole):
        if a % 50:
            continue
        scores = {k: sum(x * y for x, y in zip(whole[a][1], v)) for k, (_, v) in whole.items() if k != a}
        best = lambda keys: sorted(keys, key=lambda k: (-scores[k], k))
        for p in best(k for k in scores if whole[k][0] == whole[a][0])[:5]:
            fit = [k for k in scores if whole[k][0] != whole[a][0] and 50 * scores[p] <= 100 * scores[k] <= 95 * scores[p]]
            out += [(a, p, r, k, scores[p], scores[k]) for r, k in enumerate(best(fit)[:3], 1)]
    return sorted(out)


def mined(frame):
    return sorted(map(tuple, hard_negatives.mined(frame, F.col("id") % 50 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


VECTORS = "id long, label long, vector array<double>, extra string, block int, part int"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)


def test_negatives_are_those_of_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(k, int(k * 7919 % 6), (centres[k * 31 % 6] + 0.2 * rng.normal(size=12)).tolist()) for k in range(900)]
    rows += [(900 + k, 2, rows[50][2]) for k in range(120)]  # copies of an anchor, and ties
    rows += [(None, 1, [1.0]), (2000, None, [1.0]), (2050, 1, None), (2100, 1, [1.0, None]), (2150, 1, [float("nan")]), (2200, 1, [float("inf")]), (2250, 1, []), (2300, 1, [0.5]), (2301, 2, [0.4, 0.0]), (100, 0, [0.0] * 12)]
    expected = plain_negatives(rows)
    assert expected
    for block, at_once in ((2048, 1024), (5, 16)):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "AT_ONCE", at_once)
        assert mined(frame_of(spark, rows)) == expected


def test_negatives_of_few_or_huge_rows(spark):
    assert mined(frame_of(spark, [])) == []
    assert mined(frame_of(spark, [(1, 1, [1.0])])) == []
    assert mined(frame_of(spark, [(50, 1, [1.0]), (1, 2, [1.0])])) == []  # no positive
    huge = [(0, 1, [1e9, 3.0]), (1, 1, [2e7, 5.0]), (2, 2, [1.5e7, 1.0]), (3, 2, [1.9e7, 2.0]), (4, 1, [-1e9, 0.0])]
    assert mined(frame_of(spark, huge)) == [r for r in plain_negatives(huge) if abs(r[4]) < 2**63 and abs(r[5]) < 2**63]


def test_bounds_leave_rows_unscored(spark):
    """Near anchors of far rows need one score for all of them."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    anchors = pa.table({"id": list(range(0, 2000, 50)), "label": [1] * 40, "vector": [(base + 1e-3 * rng.normal(size=16)).tolist() for _ in range(40)]})
    tree = hard_negatives._tree(anchors.append_column("block", pa.array([0] * 40)))
    assert sorted(tree["place"].to_pylist()) == list(range(40)) and all(p < k for k, p in enumerate(tree["parent"].to_pylist()))
    exact = {k: v for k, v in zip(anchors["id"].to_pylist(), hard_negatives._matrix(anchors["vector"], 16))}
    ids, far, parent = tree["id"].to_pylist(), tree["far"].to_pylist(), tree["parent"].to_pylist()
    assert all(abs(np.linalg.norm(exact[ids[k]] - exact[ids[parent[k]]]) - far[k]) < 1e-6 for k in range(1, 40))
    assert sum(far) < 40 * 16


def plain_failures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    text = text or ""
    fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)))
    return sum(1 << k for k, f in enumerate(fails) if f)


def plain_audit(docs, labels):
    least, flags = {}, {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    for key, good, toxic in labels:
        old = flags.get(key, (False, False))
        if key is not None:  # a null is no one's label
            flags[key] = (old[0] or good == 1, old[1] or toxic == 1)
    parts = {}
    for key, text, source in docs:
        mask = plain_failures(text) | (16 if key is not None and key > least[text or ""] else 0)
        parts.setdefault(source or "", []).append((mask, *flags.get(key, (False, False))))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [r for r in left if r[0] & bit]
                left = [r for r in left if not r[0] & bit]
                total[name] += len(gone)
                fails = [r for r in rows if r[0] & bit]
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(r[0] == bit for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark, files, labels):
    folder = tempfile.mkdtemp(prefix="granary-")
    schema = "doc_id long, text string, source string, part string, cell int"
    for k, rows in enumerate(files):
        spark.createDataFrame([(*r, "x", 1) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/documents.parquet")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return filter_audit.audit(filter_audit.file_stream(spark, f"file://{folder}/documents.parquet"), marked)


def test_audit_is_that_of_plain_python_whatever_comes_first(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(n)}" for _ in range(m)) for n, m in ((500, 60), (30, 80), (400, 90), (9, 20))]
    texts += ["ABC DEF " * 40, "a # b", "", None, " \t ", "Ünïcödé wörter 日本 " * 30, "x" * 200_000, " ".join(f"v{k}" for k in range(70)) + " |"]
    docs = [(k, rng.choice(texts), rng.choice(["s1", "s2", "s2", None, ""])) for k in range(150)]
    docs += [(7, docs[7][1], "s1"), (7, docs[7][1], "s1"), (None, docs[3][1], "s1"), (None, None, None)] + [(300 - k, texts[0], "hot") for k in range(100)]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 150, 3)] + [(3, 0, 1), (6, None, None), (None, 1, 1)]
    expected = plain_audit(docs, labels)
    late_first = sorted(docs, key=lambda r: -(r[0] or 0))
    files = [late_first[:90], late_first[90:140], late_first[140:]]
    out = audited(spark, files, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in out} == expected
    assert len(out) == len(expected)


def test_later_batches_take_back_earlier_masks(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BATCHES", 2)
    text = " ".join(f"word{k}" for k in range(60))
    out = audited(spark, [[(9, text, "a"), (8, text, "b")], [(2, text, "c")]], []).where("filter_order = 'EABCD' and step = 1").collect()
    assert {r.part: (r.kept, r.removed) for r in out} == {"a": (0, 1), "b": (0, 1), "c": (1, 0)}


def test_audit_of_an_empty_table(spark):
    assert audited(spark, [[]], []).count() == 0


@pytest.fixture(scope="module")
def vocabulary(spark):
    return byte_bpe.Vocabulary(spark)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_ids_are_those_of_the_library(spark, vocabulary, library):
    rng = random.Random(11)
    spans = ((32, 127), (32, 0x3000), (0x3000, 0xD800), (0xE000, 0x24000))
    texts = ["", None, "  ", "\x00\x01 \r\n\t q", "'s 're it's 12 34a   b", "ࡰࡱ \U00016130x", byte_bpe._ENTRY + "a" + byte_bpe._VALUE, "<|endoftext|>"]
    texts += ["a" * 3000 + " b", "x" * 1500 + "\n\n  " + "ab" * 2000 + " 9", " " * 3000 + "z", "the cat " * 30_000]
    texts += ["".join(chr(rng.choice([rng.randrange(*rng.choice(spans)), 32, 10, 39])) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += texts[5:9]
    frame = spark.createDataFrame([(k % 70 or None, t, "ids", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, left int")
    for most in (byte_bpe.FREQUENT, 0):
        out = sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in byte_bpe.encode(frame, vocabulary, most=most).collect())
        assert out == sorted((k % 70 or -1, library.encode_ordinary(t or "")) for k, t in enumerate(texts))


def test_digests_of_a_table(spark, vocabulary, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    out = byte_bpe.digests(docs, vocabulary).collect()
    assert len(out) == len(text)
    for r in out:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    assert byte_bpe.digests(docs.where("false"), vocabulary).count() == 0


def test_pattern_knows_the_library_s_letters_and_numbers(spark, vocabulary, library):
    """Every seventh code point, and those that Unicode added late, after a letter, a number and a sign: the same ids as the library's."""
    points = [chr(c) for c in range(0x80, 0x24000, 7) if not 0xD800 <= c < 0xE000] + [chr(c) for c in (0x85, 0xA0, 0x870, 0xCDC, 0x1C8A, 0x10D40, 0x16130, 0x323AF, 0x2EBF0)]
    texts = ["".join(f"a{c} 1{c} !{c}{c}" for c in points[k : k + 100]) for k in range(0, len(points), 100)]
    out = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), vocabulary)
    assert {r.doc_id: list(r.ids) for r in out.collect()} == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_long_words_by_heap_are_those_of_the_library(vocabulary, library):
    for word in ("ab" * 700, "aaaa" * 300, "banana" * 200, "zq" * 600):
        assert byte_bpe.heap_ids(word.encode(), vocabulary.ranks) == library.encode_ordinary(word)


def test_batches_of_words_are_folded_like_the_library_s(spark, vocabulary, library):
    """Merges of the lowest ranks are applied to a whole batch at once, and do not cross from word to word."""
    rng = random.Random(4)
    words = ["th", "the", " the", "t", "h", "e", "aaaaa", "tthhee", " ofthdthtion", "ciónrrasmi", "日本", "\0\0"]
    words += ["".join(rng.choice("aehinorst dé") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    frame = spark.createDataFrame([(words,), ([],)], "words array<string>").select("words", vocabulary.pairs.table.scalar().alias("pairs"))
    batch = byte_bpe.with_constant(F.col("pairs"), lambda pairs: vocabulary.folded(F.col("words"), pairs))
    full, empty = (r.ids for r in frame.select(batch.alias("ids")).collect())
    one = lambda word: [library._mergeable_ranks[word]] if word in library._mergeable_ranks else byte_bpe.heap_ids(word, vocabulary.ranks)
    assert [list(map(ord, ids)) for ids in full] == [one(w.encode()) for w in words]
    assert empty == [""]


def test_sure_merges_end_where_their_order_could_matter(vocabulary):
    single = {bytes([b]): b for b in range(256)}
    assert byte_bpe.sure_merges(single) == []
    assert byte_bpe.sure_merges(single | {b"th": 300, b"the": 301, b" the": 302}) == [(b"t", b"h"), (b"th", b"e"), (b" ", b"the")]
    assert byte_bpe.sure_merges(single | {b"ab": 300, b"bc": 299, b"abd": 301}) == [(b"b", b"c"), (b"a", b"b"), (b"ab", b"d")]
    assert byte_bpe.sure_merges(single | {b"ab": 300, b"abc": 290, b"bc": 310}) == []  # abc comes from a pair of a higher rank
    found = byte_bpe.sure_merges(vocabulary.ranks)
    assert len(found) == byte_bpe.BULK and [vocabulary.ranks[a + b] for a, b in found] == list(range(256, 256 + byte_bpe.BULK))


def test_low_texts_have_the_words_of_the_whole_pattern(spark, vocabulary):
    points = [chr(c) for c in range(0x86F)] + ["\u086f", "\u0870", "\u2003"]
    texts = ["".join(f"a{c} 1{c} !{c}{c}  {c}" for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    out = frame.select(vocabulary.words(F.col("text")).alias("a"), F.regexp_extract_all("text", F.lit(vocabulary.pattern), F.lit(0)).alias("b")).collect()
    assert all(r.a == r.b and "".join(r.a) for r in out)


def test_a_batch_looks_up_each_distinct_word_once(vocabulary, library, monkeypatch):
    known = byte_bpe.word_table(pa.table({"key": pa.array(["the", " cat", "日本"]), "value": pa.array(["A", "BC", "D"])}))
    hashed, hashes = [], byte_bpe._hashes
    monkeypatch.setattr(byte_bpe, "_hashes", lambda words: hashed.extend(words.to_pylist()) or hashes(words))
    long = "ab" * 700
    rows = [["left out"], ["the", " cat", " rare"] * 500, [], ["日本", "the", long], [" rare", "x" + byte_bpe._VALUE]]
    values, others = byte_bpe.looked_up(pa.array(rows, pa.list_(pa.string())).slice(1), known, vocabulary.ranks)
    sign = byte_bpe._VALUE
    assert values.to_pylist() == [("ABC" + sign) * 500, "", "DA" + "".join(map(chr, library.encode_ordinary(long))), sign * 2]
    assert others.to_pylist() == [[" rare"] * 500, [], [], [" rare", "x" + sign]]
    assert sorted(hashed) == sorted({w for row in rows[1:] for w in row})


def test_words_of_one_hash_are_not_mistaken(vocabulary, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_hashes", lambda words: np.full(len(words), 7, np.uint64))
    known = byte_bpe.word_table(pa.table({"key": pa.array(["one", "two"]), "value": pa.array(["A", "B"])}))
    values, others = byte_bpe.looked_up(pa.array([["two", "one", "three"]]), known, vocabulary.ranks)
    assert values.to_pylist() == [byte_bpe._VALUE + "A" + byte_bpe._VALUE] and others.to_pylist() == [["two", "three"]]
    empty = byte_bpe.word_table(pa.table({"key": pa.array([], pa.string()), "value": pa.array([], pa.string())}))
    assert byte_bpe.looked_up(pa.array([["two"], []], pa.list_(pa.string())), empty, vocabulary.ranks)[1].to_pylist() == [["two"], []]


def test_decoding_gives_no_bytes_for_ids_without_a_piece(vocabulary):
    texts = ["the cat", "", "日本"]
    ids, ends = byte_bpe._points(pa.array(["".join(chr(vocabulary.ranks[bytes([b])]) for b in t.encode()) for t in texts]))
    assert byte_bpe.decoded(ids, ends, vocabulary.pieces).to_pylist() == [t.encode() for t in texts]
    assert byte_bpe.decoded(np.array([vocabulary.ranks[b"t"], 55_000], "<u4"), np.array([0, 2]), vocabulary.pieces).to_pylist() == [b"t"]


def test_vocabularies_are_checked():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(None, {bytes([b]): b + 60_000 for b in range(256)})
