"""Benchmark decontamination by greedy string tiling.

Texts become words of letters and digits, A-Z lowered.  The hash of every window of ``seed`` words is rolled over texts and benchmark items
(running Karp-Rabin); windows of texts that a bit table of the benchmark's windows lets through are joined with the benchmark on the hash.
For each text and item that share a seed, the longest unmarked common run is marked again and again, never overlapping what is marked, until
no run of ``seed`` words is left.  The item's marked share is its coverage.  Runs may lie in any order, so reordered passages count in full.
A text is contaminated if an item's coverage reaches ``threshold``.

A seed that many texts and items hold would pair them all.  Where only coverage from ``least`` up counts, tiles of an item of n words hold at
least ceil(least * n / seed) of its places without a common word, so at least as many of its places match.  Such a text matches one of the
item's rarest places, all but that number less one; only these make pairs, and no pair that reaches ``least`` is lost.  A phrase that a text
and an item both repeat travels as two lists of places, not as their product.

Items shorter than ``seed`` words, null and empty texts and items match nothing; repeated items give equal
rows; the item with the largest coverage, the smallest id among ties, is a text's best.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NOT_ALNUM, Hasher, find_words, stash, text_chunks, window_hashes

SEED = 5
THRESHOLD = 0.5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  # of the bit table: 128 KB to 16 MB; beyond it only lets more through
PAIRS = 1 << 20  # matches of one text and item that are held at once


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, int]]:
    """Window hashes and word count of each row."""
    starts, ends, at = find_words(data, offsets, NOT_ALNUM)
    words = Hasher(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    windows = window_hashes(words, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield windows[a : max(a, b - width + 1)], b - a


def seeds(texts: DataFrame, id_col: str, text_col: str, width: int = SEED, table=None) -> DataFrame:
    """``id, words, place, seed`` of every window, or of those that the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = None if table is None else np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                row, words, place, seed = [], [], [], []
                for k, (hashes, n) in enumerate(_windows(data, offsets, width)):
                    at = np.arange(len(hashes))
                    if packed is not None:
                        bit = (hashes & np.uint64(8 * len(packed) - 1)).astype(np.int64)
                        at = np.flatnonzero(packed[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    row.append(np.full(len(at), first + k))
                    words.append(np.full(len(at), n))
                    place.append(at)
                    seed.append(hashes[at])
                take = np.concatenate(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(np.concatenate(words)), pa.array(np.concatenate(place)), pa.array(np.concatenate(seed).view(np.int64))], ["id", "words", "place", "seed"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, words long, place long, seed long")


def bit_table(items: DataFrame) -> bytes:
    """Bits that hold the items' seeds, about 16 for each within fixed bounds, merged from the partitions' tables."""
    size = min(max(LEAST_BITS, 1 << (16 * items.count()).bit_length()), MOST_BITS)
    page = 1 << 15  # bits of one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (size - 1)] = 1
        packed = np.packbits(bits, bitorder="little").reshape(-1, page // 8)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([packed[k].tobytes() for k in full], pa.binary())], ["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(bits, np.uint8)
                parts[part] = parts[part] | more if part in parts else more
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["part", "bits"])

    table = np.zeros(size // 8, np.uint8).reshape(-1, page // 8)
    merged = items.select("seed").mapInArrow(run, "part long, bits binary").repartition(F.col("part")).mapInArrow(merge, "part long, bits binary")
    for part, bits in merged.collect():  # at most MOST_BITS bits
        table[part] |= np.frombuffer(bits, np.uint8)
    return table.tobytes()


def tile(pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text place, item place, words) from the seed matches of one text and one item.

    Runs of seeds on a diagonal are common runs of words.  The longest unmarked run is marked first, ties by text place and then item place;
    a run that meets marked words is cut to its unmarked parts.
    """
    at: dict[int, list[int]] = {}
    for text, item in pairs:
        at.setdefault(text - item, []).append(item)
    runs: list[tuple[int, int, int]] = []
    for diagonal, items in at.items():
        items = sorted(set(items))
        first = last = items[0]
        for k in [*items[1:], None]:
            if k is not None and k == last + 1:
                last = k
                continue
            runs.append((-(last - first + width), first + diagonal, first))
            first = last = k if k is not None else 0
    heapq.heapify(runs)
    in_text: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while runs:
        length, text, item = heapq.heappop(runs)
        length = -length
        free = [text + k not in in_text and item + k not in in_item for k in range(length)]
        if all(free):
            in_text.update(range(text, text + length))
            in_item.update(range(item, item + length))
            tiles.append((text, item, length))
            continue
        first = None
        for k, ok in enumerate([*free, False]):
            if ok and first is None:
                first = k
            elif not ok and first is not None:
                if k - first >= width:
                    heapq.heappush(runs, (-(k - first), text + first, item + first))
                first = None
    return tiles


def tile_places(shared: list[tuple[list[int], list[int]]], width: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile`` from each common seed's places in the text and in the item, with memory for the places alone.

    Windows of 1, 2, 4, ... seeds are numbered so that equal ones have one number; two of them tell windows of any length.  The longest common
    unmarked run is found by halving, as a part of a common run is one too.
    """
    if sum(len(a) * len(b) for a, b in shared) <= PAIRS:
        return tile([(x, y) for a, b in shared for x in a for y in b], width)
    sides = []
    for side in (0, 1):
        place = np.array([x for s in shared for x in s[side]], np.int64)
        numbers = np.full(int(place.max()) + 1, len(shared) + side, np.int64)  # a seed that isn't common
        numbers[place] = [k for k, s in enumerate(shared) for _ in s[side]]
        sides.append(numbers)
    split = len(sides[0])
    levels = [np.concatenate(sides)]
    while 2 << len(levels) - 1 <= min(map(len, sides)):
        half = 1 << len(levels) - 1
        pair = levels[-1][:-half] * (len(levels[0]) + 2) + levels[-1][half:]
        levels.append(np.unique(pair, return_inverse=True)[1])
    free = [np.ones(len(s) + width - 1, bool) for s in sides]  # words

    def equal(n: int) -> tuple[int, int] | None:
        """The first places in text and item of a common run of ``n`` unmarked words."""
        k = n - width + 1
        level = k.bit_length() - 1
        ranks, far = levels[level], k - (1 << level)
        first = []
        for begin, unmarked in zip((0, split), free):
            count = len(unmarked) - n + 1
            marked = np.concatenate([[0], np.cumsum(~unmarked)])
            at = np.flatnonzero(marked[n:] == marked[:count])
            value, where = np.unique(ranks[begin + at] * (len(levels[0]) + 2) + ranks[begin + at + far], return_index=True)
            first.append((value, at[where]))
        _, a, b = np.intersect1d(first[0][0], first[1][0], return_indices=True)
        if not len(a):
            return None
        texts, items = first[0][1][a], first[1][1][b]
        k = int(np.lexsort((items, texts))[0])
        return int(texts[k]), int(items[k])

    tiles, longest = [], min(map(len, free))
    while True:
        low, high, found = width - 1, longest + 1, None
        while high - low > 1:
            middle = (low + high) // 2
            hit = equal(middle)
            low, high, found = (middle, high, hit) if hit else (low, middle, found)
        if found is None:
            return tiles
        tiles.append((*found, low))
        for unmarked, first in zip(free, found):
            unmarked[first : first + low] = False
        longest = low


def _tiled(matches: DataFrame, width: int) -> DataFrame:
    kind = matches.schema["id"].dataType.simpleString()
    item_kind = matches.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, longest, n = [], [], []
            for shared in batch.column(3).to_pylist():
                tiles = tile_places([(s["places"], s["item_places"]) for s in shared], width)
                covered.append(sum(t[2] for t in tiles))
                longest.append(max((t[2] for t in tiles), default=0))
                n.append(len(tiles))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(covered, pa.int64()), pa.array(longest, pa.int64()), pa.array(n, pa.int64())], ["id", "item", "item_words", "covered", "longest", "tiles"])

    return matches.select("id", "item", "item_words", "shared").mapInArrow(run, f"id {kind}, item {item_kind}, item_words long, covered long, longest long, tiles long")


def _telling(wanted: DataFrame, found: DataFrame, width: int, least: float) -> DataFrame:
    """``item, item_words, seed``: the seeds at each item's rarest places, one of which every text of coverage ``least`` holds."""
    held = found.groupBy("seed").agg(F.count("*").alias("holders"))
    places = wanted.join(held, "seed").select("item", "item_words", "seed", "holders", F.explode("item_places").alias("place"))
    ranked = places.groupBy("item", "item_words").agg(F.array_sort(F.collect_list(F.struct("holders", "seed"))).alias("all"))  # as many as the item's words
    # places that no text holds are the rarest of all and need no pair
    silent = F.col("item_words") - width + 1 - F.size("all")
    need = F.greatest(F.lit(1), F.ceil(F.col("item_words") * least / width - 1e-9))
    take = F.greatest(F.lit(0), F.col("item_words") - width + 1 - need + 1 - silent).cast("int")
    return ranked.select("item", "item_words", F.explode(F.array_distinct(F.transform(F.slice("all", F.lit(1), take), lambda x: x["seed"]))).alias("seed"))


def coverage(texts: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, least: float = 0.0) -> DataFrame:
    """``id, item, item_words, covered, longest, tiles`` of each text and item that share a seed; with ``least``, of all that reach that coverage and some others."""
    spark = texts.sparkSession
    items = stash(seeds(benchmark, item_col, item_text_col, seed), "items")
    table = spark.sparkContext.broadcast(bit_table(items))
    wanted = items.groupBy(F.col("id").alias("item"), F.col("words").alias("item_words"), "seed").agg(F.array_sort(F.collect_set("place")).alias("item_places"))
    found = seeds(texts, id_col, text_col, seed, table).groupBy("id", "seed").agg(F.array_sort(F.collect_set("place")).alias("places"))
    found = stash(found.join(items.select("seed").distinct(), "seed", "left_semi"), "found")
    matches = found.join(wanted, "seed")
    if least > 0:
        pairs = found.select("id", "seed").join(_telling(wanted, found, seed, least), "seed").select("id", "item", "item_words").distinct()
        matches = pairs.join(found, "id").join(wanted, ["item", "item_words", "seed"])
    return _tiled(matches.groupBy("id", "item", "item_words").agg(F.collect_list(F.struct("places", "item_places")).alias("shared")), seed)


def decontaminated(texts: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, threshold: float = THRESHOLD, least: float = 0.0) -> DataFrame:
    """One row a text: best item, its coverage (0 without a shared seed), tiles, and whether the text is contaminated.

    With ``least``, coverage below it may be given as less than it is.
    """
    share = F.col("covered") / F.col("item_words")
    best = coverage(texts, benchmark, id_col, text_col, item_col, item_text_col, seed, least).groupBy("id").agg(F.min(F.struct((-share).alias("order"), F.col("item"), F.col("covered"), F.col("tiles"))).alias("b"))
    best = stash(best.select("id", (-F.col("b.order")).alias("coverage"), "b.item", "b.covered", "b.tiles"), "best")
    rows = texts.select(F.col(id_col).alias("id")).join(best, "id", "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("item").alias("best_item"), F.coalesce("covered", F.lit(0)).alias("covered_words"), F.coalesce("tiles", F.lit(0)).alias("tiles"), (F.coalesce("coverage", F.lit(0.0)) >= threshold).alias("contaminated"))


def keep_clean(texts: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that no benchmark item covers to ``threshold``."""
    found = coverage(texts, benchmark, id_col, text_col, seed=seed, least=threshold).where(F.col("covered") >= threshold * F.col("item_words"))
    gone = stash(found.select(F.col("id").alias("_id")).distinct(), "contaminated")
    return texts.join(gone, F.col(id_col) == F.col("_id"), "left_anti")
