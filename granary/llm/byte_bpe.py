"""Byte-level BPE with the ranks of a public vocabulary: higher-order functions fold ranked merges over the bytes of a word.

A text's words are the matches of the vocabulary's pattern.  The words that occur most often in all texts are folded once each, as rows of their
own, and become a broadcast table of a bounded size; every other word is folded where it stands, so that no text is joined or shuffled.  Tasks look
up each distinct word of ``ROWS`` texts once, and take the values of all words, and the bytes of all ids, from Arrow arrays.

Words are folded in batches: the merges of the lowest ranks, which are most of a word's, are applied to all words of a batch end to end, one after
the other; what is left is folded a word at a time, by the least rank of its pairs.

A fold copies the word's pieces once a merge, which is quadratic, so words of over ``LONG_WORD`` bytes go through a heap of pairs in Python
instead; both give the same ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Hasher, bounded_batches, stash

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of the table of frequent words: entries, and bytes of a word.
FREQUENT, FREQUENT_BYTES = 1 << 20, 64
LONG_WORD, SURROGATES = 1024, 0xD800
#: Merges that are applied to a whole batch, and frequent words of a batch.
BULK, BATCH_WORDS = 64, 256
#: Texts whose words are looked up, or whose ids are decoded, at once: each of a task's two Python workers holds all of their words as numbers.
ROWS = 128

# Letters and numbers that Unicode 14 to 16 added, which the pattern's engine knows and the JVM's may not, and its white space.
_NEW_LETTERS = (
    r"\x{870}-\x{887}\x{889}-\x{88E}\x{8B5}\x{8C8}-\x{8C9}\x{C5D}\x{CDD}\x{170D}\x{171F}\x{1B4C}\x{1C89}-\x{1C8A}\x{2C2F}\x{2C5F}\x{9FFD}-\x{9FFF}"
    r"\x{A7C0}-\x{A7C1}\x{A7CB}-\x{A7CD}\x{A7D0}-\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7DC}\x{A7F2}-\x{A7F4}\x{10570}-\x{1057A}\x{1057C}-\x{1058A}\x{1058C}-\x{10592}"
    r"\x{10594}-\x{10595}\x{10597}-\x{105A1}\x{105A3}-\x{105B1}\x{105B3}-\x{105B9}\x{105BB}-\x{105BC}\x{105C0}-\x{105F3}\x{10780}-\x{10785}\x{10787}-\x{107B0}"
    r"\x{107B2}-\x{107BA}\x{10D4A}-\x{10D65}\x{10D6F}-\x{10D85}\x{10EC2}-\x{10EC4}\x{10F70}-\x{10F81}\x{11071}-\x{11072}\x{11075}\x{1123F}-\x{11240}"
    r"\x{11380}-\x{11389}\x{1138B}\x{1138E}\x{11390}-\x{113B5}\x{113B7}\x{113D1}\x{113D3}\x{11740}-\x{11746}\x{11AB0}-\x{11ABF}\x{11BC0}-\x{11BE0}\x{11F02}"
    r"\x{11F04}-\x{11F10}\x{11F12}-\x{11F33}\x{12F90}-\x{12FF0}\x{1342F}\x{13441}-\x{13446}\x{13460}-\x{143FA}\x{16100}-\x{1611D}\x{16A70}-\x{16ABE}"
    r"\x{16D40}-\x{16D6C}\x{18CFF}\x{1AFF0}-\x{1AFF3}\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}\x{1B11F}-\x{1B122}\x{1B132}\x{1B155}\x{1DF00}-\x{1DF1E}"
    r"\x{1DF25}-\x{1DF2A}\x{1E030}-\x{1E06D}\x{1E290}-\x{1E2AD}\x{1E4D0}-\x{1E4EB}\x{1E5D0}-\x{1E5ED}\x{1E5F0}\x{1E7E0}-\x{1E7E6}\x{1E7E8}-\x{1E7EB}"
    r"\x{1E7ED}-\x{1E7EE}\x{1E7F0}-\x{1E7FE}\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B739}\x{2EBF0}-\x{2EE5D}\x{31350}-\x{323AF}"
)
_NEW_NUMBERS = r"\x{10D40}-\x{10D49}\x{116D0}-\x{116E3}\x{11BF0}-\x{11BF9}\x{11F50}-\x{11F59}\x{16130}-\x{16139}\x{16AC0}-\x{16AC9}\x{16D70}-\x{16D79}\x{1CCF0}-\x{1CCF9}\x{1D2C0}-\x{1D2D3}\x{1E4F0}-\x{1E4F9}\x{1E5F1}-\x{1E5FA}"
#: The first of these letters; below it the JVM's letters and numbers are the engine's, and white space is short.
_FIRST_NEW, _LOW_SPACE = r"\x{870}", r"\t-\r \x{85}\x{A0}"
_SPACE = _LOW_SPACE + r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def jvm_pattern(pattern: str = public_tokenizers.PATTERN, low: bool = False) -> str:
    """The pattern in Java's notation, with the letters, numbers and white space of the pattern's own engine; ``low``: for texts without a character
    from the first new letter on.

    The intersections make a character below the first new one cost a single comparison.
    """
    new = lambda ranges: "" if low else rf"[{_FIRST_NEW}-\x{{323AF}}&&[{ranges}]]"
    space = _LOW_SPACE if low else _SPACE
    letters, numbers = rf"\p{{L}}{new(_NEW_LETTERS)}", rf"\p{{N}}{new(_NEW_NUMBERS)}"
    inside = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": space}
    out, depth = [], 0
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        depth += (part == "[") - (part == "]")
        if part in inside:
            part = inside[part] if depth else f"[{inside[part]}]"
        elif part == r"\S":
            part = f"[^{space}]"
        out.append(part)
    return "".join(out)


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Rank of each byte string of a vocabulary file; every single byte must have one.  The file is read on the driver."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    return ranks


def sure_merges(ranks: dict[bytes, int], most: int = BULK) -> list[tuple[bytes, bytes]]:
    """The pairs that make the pieces of the lowest ranks, in the order of ranks, as far as they may be merged one after the other.

    The bytes that become a piece are merged among themselves as if they stood alone, until a merge crosses their border.  If alone they become the
    piece by merges of no higher rank, then wherever all lower ranks are done, the piece is whole already or comes from the last of these pairs;
    and no merge makes a pair of a lower rank.  The list ends before the first piece of which that isn't so.
    """
    out = []
    for rank, piece in sorted((r, p) for p, r in ranks.items() if len(p) > 1)[:most]:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            least, k = min((ranks.get(a + b, rank + 1), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if least > rank:
                return out
            pair = parts[k], parts[k + 1]
            parts[k : k + 2] = [b"".join(pair)]
        out.append(pair)
    return out


#: Signs around keys and values of a map's entries; no id is one of them.
_ENTRY, _VALUE = chr(SURROGATES - 1), chr(SURROGATES - 2)


class Lookup:
    """A map of strings that is a constant of a plan: an array of strings by the key's hash, each with its entries end to end.

    Spark searches a map's keys one by one as objects, and prints a literal as a whole in every plan; so the map is the one row of a small table,
    which a scalar subquery turns into a constant before tasks begin, and string functions find an entry.  A column of it must be named once only,
    as by ``with_constant``, so that it isn't copied into rows.  Keys, of one string or more, must hold neither sign, and values are not empty.  The
    values' sign begins each string, so that it stands for the value of a key without one.
    """

    def __init__(self, n: int, table: DataFrame) -> None:
        self.n, self.table = n, table

    @staticmethod
    def slots(entries: int) -> int:
        return 1 << max(4, entries.bit_length())

    @classmethod
    def of(cls, spark: SparkSession, entries: dict[tuple[str, ...], str]) -> Lookup:
        """A map that the driver knows."""
        n = cls.slots(len(entries))
        slots = [_VALUE] * n
        for key, value in entries.items():
            hashed = 42
            for part in key:
                hashed = xxhash.xxh64_intdigest(part.encode(), hashed)
            slots[hashed % n] += _ENTRY + "".join(key) + _VALUE + value
        return cls(n, constant(spark, slots))

    def found(self, table: Column, *key: Column) -> Column:
        """The slot from the key's value on; where it lacks the key, it begins with the values' sign."""
        slot = F.get(table, F.xxhash64(*key).bitwiseAND(F.lit(self.n - 1)).cast("int"))
        return F.call_function("substring_index", slot, F.concat(F.lit(_ENTRY), *key, F.lit(_VALUE)), F.lit(-1))


def constant(spark: SparkSession, value: list[str]) -> DataFrame:
    """A local table of one row that holds ``value``."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return spark.createDataFrame([(text,)], "text string").select(F.from_json("text", "array<string>").alias("value"))


def with_constant(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class Vocabulary:
    """Ranks as constants of a plan.

    An id is a character with that code point, so ids of a text are a string and merges are string functions.  Ids therefore lie below the first
    surrogate, 55,296.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int] | None = None, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks = ranks or read_ranks()
        self.pattern, self.low_pattern = jvm_pattern(pattern), jvm_pattern(pattern, low=True)
        if not 0 <= min(ranks.values()) <= max(ranks.values()) < SURROGATES - 2:
            raise ValueError(f"ids must be from 0 to {SURROGATES - 3}")  # two characters are signs of their own
        self.bytes = "".join(chr(ranks[bytes([b])] or SURROGATES - 2) for b in range(256))
        pairs = {}
        for key, value in ranks.items():
            for cut in range(1, len(key)):
                if key[:cut] in ranks and key[cut:] in ranks:
                    pairs[chr(ranks[key[:cut]]), chr(ranks[key[cut:]])] = chr(value)
        self.pairs = Lookup.of(spark, pairs)
        first = [(chr(ranks[a]) + chr(ranks[b]), chr(ranks[a + b])) for a, b in sure_merges(ranks)]
        self.first = F.array(*(F.struct(F.lit(pair).alias("pair"), F.lit(made).alias("made")) for pair, made in first))
        pieces = [b""] * (max(ranks.values()) + 2)  # the last is that of any higher id
        for key, value in ranks.items():
            pieces[value] = key
        self.pieces = pa.array(pieces, pa.binary())

    def words(self, text: Column) -> Column:
        """All matches of the pattern, which cover the text."""
        found = lambda pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.when(F.rlike(text, F.lit(rf"[{_FIRST_NEW}-\x{{10FFFF}}]")), found(self.pattern)).otherwise(found(self.low_pattern))

    def folded(self, words: Column, pairs: Column) -> Column:
        """Ids of each word of an array; of no word, one empty string."""
        latin = "".join(map(chr, range(256)))
        placed = lambda w: F.translate(F.decode(w.cast("binary"), "ISO-8859-1"), latin, self.bytes)
        ids = F.replace(F.array_join(F.transform(words, placed), _ENTRY), F.lit(chr(SURROGATES - 2)), F.lit("\0"))  # translate takes a zero for nothing
        merged = F.aggregate(self.first, ids, lambda s, m: F.replace(s, m["pair"], m["made"]))
        return F.transform(F.split(merged, _ENTRY), lambda p: self.fold(p, pairs))

    def fold(self, pieces: Column, pairs: Column) -> Column:
        """Pieces of one word, folded: as often as there are pieces but one, the leftmost pair of the lowest rank becomes one piece.

        A step holds the pieces' ids ``p`` between two signs, the ids ``k`` that each of them and the next would make, and the least ``m`` of these,
        the next merge.
        """
        none, sign = F.lit(_VALUE), F.lit(_ENTRY)
        made = lambda *pair: F.substring(self.pairs.found(pairs, *pair), F.lit(1), F.lit(1))  # noqa: E731  one character
        at = lambda s, n: F.substring(s, n, F.lit(1))
        state = lambda p, k: with_constant(k, lambda k: F.struct(p.alias("p"), k.alias("k"), F.array_min(F.split(k, "")).alias("m")))

        def merged(s: Column, i: Column) -> Column:
            p, x = s["p"], s["m"]
            left = F.when(i > 2, made(at(p, i - 1), x)).otherwise(none)
            right = F.when(i < F.length(s["k"]) - 1, made(x, at(p, i + 2))).otherwise(none)
            return state(F.overlay(p, x, i, F.lit(2)), F.overlay(s["k"], F.concat(left, right), i - 1, F.lit(3)))

        def step(s: Column, _: Column) -> Column:
            return F.when(s["m"] < none, with_constant(F.instr(s["k"], s["m"]), lambda i: merged(s, i))).otherwise(s)

        def stepped(rest: Column) -> Column:
            pairs_of = F.zip_with(F.split(F.substring(pieces, F.lit(1), F.length(pieces) - 1), ""), rest, lambda a, b: made(a, b))
            start = state(F.concat(sign, pieces, sign), F.concat(none, F.array_join(pairs_of, ""), none))
            return F.aggregate(rest, start, step, lambda s: F.substring(s["p"], F.lit(2), F.length(s["p"]) - 2))

        rest = F.split(F.substring(pieces, F.lit(2), F.length(pieces)), "")
        return F.when(F.length(pieces) < 2, pieces).otherwise(with_constant(rest, stepped))

def _ends(lengths: pa.Array) -> np.ndarray:
    """Where each of some values ends, after a zero."""
    return np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)))


def _cut(data: pa.Buffer | None, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An array of parts of a buffer."""
    return pa.Array.from_buffers(kind or pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data or pa.py_buffer(b"")])


def _points(folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, end to end, and where each string ends."""
    return np.frombuffer("".join(folded.to_pylist()).encode("utf-32-le"), "<u4"), _ends(pc.utf8_length(folded))


def _hashes(words: pa.Array) -> np.ndarray:
    ends = _ends(pc.binary_length(words))
    data = words.buffers()[2]
    begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
    return Hasher(np.frombuffer(data or b"", np.uint8)[begin : begin + ends[-1]], lower=False)(ends[:-1], ends[1:])


def word_table(known: pa.Table) -> pa.Table:
    """``hash, key, value`` of the frequent words in the order of hashes; last comes an empty key, the place of words that are missing."""
    known = pa.table({c: pa.concat_arrays([*(x.cast(pa.string()) for x in known[c].chunks), pa.array([end])]) for c, end in (("key", ""), ("value", _VALUE))})
    hashes = _hashes(known["key"].combine_chunks())
    hashes[-1] = np.iinfo(np.uint64).max
    order = np.argsort(hashes, kind="stable")
    order = np.append(order[order < len(order) - 1], len(order) - 1)
    return known.take(pa.array(order)).combine_chunks().append_column("hash", pa.array(hashes[order]))


def decoded(ids: np.ndarray, ends: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The bytes of each text's ids, which end at ``ends``; an id that the vocabulary lacks is no bytes."""
    parts = pieces.take(pa.array(np.minimum(ids, len(pieces) - 1)))
    return _cut(parts.buffers()[2], _ends(pc.binary_length(parts))[ends])


def looked_up(words: pa.ListArray, known: pa.Table, ranks: dict[bytes, int]) -> tuple[pa.Array, pa.Array]:
    """Of each text's words, the values end to end, where the values' sign stands for each word without one, and those words.

    ``known``: as by ``word_table``.  Each distinct word is looked up once; of two frequent words of one hash, the later is as if it were missing.
    Long words without a value get theirs by the heap.
    """
    hashes, keys, values = (known[c].chunk(0) for c in ("hash", "key", "value"))
    flat, starts, none = words.flatten().dictionary_encode(), words.offsets.to_numpy().astype(np.int64), len(keys) - 1
    place = np.searchsorted(hashes.to_numpy(), _hashes(flat.dictionary))
    place[~pc.equal(keys.take(pa.array(place)), flat.dictionary).to_numpy(zero_copy_only=False)] = none
    long = np.flatnonzero((place == none) & (pc.binary_length(flat.dictionary).to_numpy() > LONG_WORD))
    if len(long):
        place[long] = none + 1 + np.arange(len(long))
        values = pa.concat_arrays([values, pa.array(["".join(map(chr, heap_ids(w.encode(), ranks))) for w in flat.dictionary.take(pa.array(long)).to_pylist()])])
    starts, indices = starts - starts[0], flat.indices.to_numpy()
    found, missing = values.take(pa.array(place)).take(flat.indices), (place == none)[indices]
    counts = np.concatenate(([0], np.cumsum(missing)))[starts]
    others = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), flat.dictionary.take(pa.array(indices[missing])))
    return _cut(found.buffers()[2], _ends(pc.binary_length(found))[starts], pa.string()), others


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: pairs in a heap by rank and place, pieces in a linked list."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    alive = [True] * n

    def pair(a: int) -> int | None:
        b = end[a]
        return ranks.get(word[a : end[b]]) if b < n else None

    heap = [(r, a, a + 2) for a in range(n - 1) if (r := pair(a)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, a, stop = heapq.heappop(heap)
        if not alive[a] or end[a] >= n or end[end[a]] != stop or ranks.get(word[a:stop]) != rank:
            continue
        alive[end[a]] = False
        end[a] = stop
        if stop < n:
            before[stop] = a
        for x in (before[a], a):
            if x >= 0 and (r := pair(x)) is not None:
                heapq.heappush(heap, (r, x, end[end[x]]))
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def frequent_words(words: DataFrame, vocabulary: Vocabulary, most: int = FREQUENT) -> DataFrame:
    """``key, value``: the words that occur most often, at most ``most`` of them, and their ids, each folded once; ``words`` has word.

    Which count a word needs comes from a histogram of all counts in sixteenths of powers of two.
    """
    counts = words.where(F.octet_length("word") <= FREQUENT_BYTES).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = stash(counts.withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    held, least, taken = 0, 1 << 30, 0
    for row in sorted(counts.groupBy("bin").agg(F.count("*").alias("words")).collect(), reverse=True):
        held += row.words
        if held > most:
            break
        least, taken = row.bin, held
    batch = F.pmod(F.xxhash64("word"), F.lit(max(1, taken // BATCH_WORDS)))
    chosen = counts.where(F.col("bin") >= least).groupBy(batch).agg(F.collect_list("word").alias("words")).select("words", vocabulary.pairs.table.scalar().alias("pairs"))
    folded = with_constant(F.col("pairs"), lambda pairs: vocabulary.folded(F.col("words"), pairs))
    return chosen.select(F.inline(F.zip_with("words", folded, lambda w, v: F.struct(w.alias("key"), v.alias("value")))))


def in_batches(df: DataFrame, made: Callable[..., tuple[pa.Array, ...]], schema: str) -> DataFrame:
    """The first column, with what ``made`` makes of the other, of ``ROWS`` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, ROWS) for k in range(0, len(batch), ROWS)):
                yield pa.RecordBatch.from_arrays([part.column(0), *made(part.column(1))], names)

    fields = StructType.fromDDL(schema)
    names = [df.columns[0], *fields.names]
    return df.mapInArrow(run, StructType([df.schema[0], *fields]))


def folded_texts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", most: int = FREQUENT) -> DataFrame:
    """``key, folded``: the ids of every text as characters.

    Rows stay apart, so repeated rows give repeated results and any kind of key, null too, will do.  Null and empty texts have no ids; columns
    other than key and text are ignored, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).alias("key"), vocabulary.words(F.col(text)).alias("words"))
    known = spark.sparkContext.broadcast(word_table(frequent_words(docs.select(F.explode("words").alias("word")), vocabulary, most).toArrow()))
    ranks = vocabulary.ranks
    found = in_batches(docs, lambda words: looked_up(words, known.value, ranks), "values string, others array<string>")

    def filled(values: Column, others: Column) -> Column:
        # each sign replaced by the next of the others
        return F.array_join(F.zip_with(F.split(values, _VALUE), others, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    whole = lambda pairs: F.when(F.size("others") == 0, F.col("values")).otherwise(filled(F.col("values"), vocabulary.folded(F.col("others"), pairs)))
    return found.select("*", vocabulary.pairs.table.scalar().alias("pairs")).select(F.col("key").alias(key), with_constant(F.col("pairs"), whole).alias("folded"))


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", most: int = FREQUENT) -> DataFrame:
    """``key, ids`` of every text, as by ``folded_texts``."""

    def made(folded: pa.Array) -> tuple[pa.Array]:
        ids, ends = _points(folded)
        return (pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))),)

    return in_batches(folded_texts(docs, vocabulary, key, text, most), made, "ids array<int>")


def digests(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", most: int = FREQUENT) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: each text encoded, and its ids decoded again."""
    pieces = vocabulary.pieces

    def made(folded: pa.Array) -> tuple[pa.Array, ...]:
        ids, ends = _points(folded)
        return pa.array(np.diff(ends)), _cut(pa.py_buffer(ids), 4 * ends), decoded(ids, ends, pieces)

    out = in_batches(folded_texts(docs, vocabulary, key, text, most), made, "n_tokens long, ids binary, decoded binary")
    return out.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
