"""Near duplicates by HyperMinHash sketches, banding and exact confirmation.

A sketch has ``REGISTERS`` buckets.  Every shingle is dealt to a bucket, and the bucket keeps its smallest value in compressed form: the
number of leading zeros and ``MANTISSA`` bits after them.  Texts with few shingles deal them again in further seeded rounds until each bucket
is full (a value of an earlier round is smaller), so that two registers agree with the probability of the sets' Jaccard similarity at any size.

``BANDS`` bands of ``ROWS`` registers find candidates: at similarity 0.75 one is missed with probability (1 - 0.75**6)**60 < 1e-5.
Candidates pass an estimate from the registers, corrected for collisions of compressed values, with a margin of over six standard errors,
and are then confirmed on the full shingle sets.

Shingles are hashed twice, under independent seeds: sketches use one hash and the confirming sets the other, so that no link rests on one hash.

Exact copies (equal sets by size, a sum over one hash and a sum over the other) form one class first, so that copies are never paired.  Inside a band's bucket, pairs are not all emitted: each
member is first tried against one pivot, then against every bucket's pivot, and only members whose components still differ are tried with
each other, if a shingle that is rare among these members can be the first of enough common ones.  The components are exact for the candidates that the bands give.

Null and empty texts have an empty set and are linked with nothing, rows with a null id neither (their component is null, and they are kept).  Repeated rows of one id give a row each and must have one text.  Empty tables give no rows;
other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import mix, shingle_rows, shingle_sets, stash, text_chunks

ROWS, BANDS = 6, 60
REGISTERS = ROWS * BANDS
MANTISSA = 10
_ROUND_SEED = np.uint64(0xC2B2AE3D27D4EB4F)
#: Six standard errors of an estimate from REGISTERS registers at 0.75 are 0.137.
MARGIN = 0.14
CONFIRM_SEED = 1
#: Shingles in front of a match that are compared.
BEFORE = 8


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers (16 bits each) of one set of 64-bit shingle hashes.

    Values of round 0 are 5 bits of leading zeros and the mantissa; later rounds have the top bit set and 15 bits of a mix of both and the round.
    """
    n = len(shingles)
    best = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    first = 0
    while n:
        empty = np.count_nonzero(best == np.uint64(0xFFFFFFFFFFFFFFFF))
        if not empty:
            break
        count = 1 if first == 0 and n >= 4 * REGISTERS else max(1, min(64, int(REGISTERS * (np.log(empty) + 0.5) / n) + 1))
        rounds = np.arange(first, first + count, dtype=np.uint64)
        if first + count > 65535:
            raise ValueError("a sketch didn't fill")
        hashes = mix(shingles[None, :] + (rounds * _ROUND_SEED)[:, None])
        bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        value = (rounds << np.uint64(32))[:, None] | (hashes & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, bucket.ravel().astype(np.intp), value.ravel())
        first += count
    low = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bits = np.frexp(low.astype(np.float64))[1]  # length in bits: 32 minus the leading zeros
    zeros = np.minimum(32 - bits, 31)
    tail = np.maximum(bits - 1, 0)
    rest = low - np.where(bits > 0, 1 << tail, 0)
    mantissa = np.where(tail >= MANTISSA, rest >> np.maximum(tail - MANTISSA, 0), rest << np.maximum(MANTISSA - tail, 0))
    code = (zeros << MANTISSA | mantissa).astype(np.uint64)
    late = (best >> np.uint64(32)) > 0
    mixed = (mix(code + (best >> np.uint64(32)) * _ROUND_SEED) & np.uint64(0x7FFF)) | np.uint64(0x8000)
    return np.where(late, mixed, code).astype("<u2")


def collision_rate() -> float:
    """Probability that registers of disjoint sets agree: both have the same leading zeros (1/3 for equal loads) and the same mantissa."""
    return 2.0**-MANTISSA / 3


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, low, high, sketch`` of each row: set size, 128 bits that identify the set, registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                n, low, high, regs = [], [], [], []
                for row, again in zip(shingle_rows(data, offsets), shingle_rows(data, offsets, seed=CONFIRM_SEED)):
                    s, where = np.unique(row, return_index=True)
                    n.append(len(s))
                    low.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    high.append(int(mix(again[where]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    regs.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(regs, pa.binary())], ["id", "n", "low", "high", "sketch"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, low long, high long, sketch binary")


def shingle_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, shingles``: the full set of each row as 64-bit hashes of the confirming seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                sets = list(shingle_sets(data, offsets, seed=CONFIRM_SEED))
                where = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(where), pa.array(values))], ["id", "shingles"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, shingles array<long>")


def estimated(pairs: DataFrame) -> DataFrame:
    """Adds ``estimate`` to rows with the binary columns ``sa, sb``: agreeing registers, less the expected collisions."""
    chance = collision_rate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (2, 3))
            same = (a == b).mean(axis=1) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.maximum(0, (same - chance) / (1 - chance)))], ["a", "b", "estimate"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, estimate double")


class _Finder:
    """State of one run: classes with sketches, buckets with several members, and the sets of those members."""

    def __init__(self, docs: DataFrame, classes: DataFrame, num: int, den: int, id_col: str, text_col: str) -> None:
        self.num, self.den, self.classes = num, den, classes
        bands = F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(BANDS)]))
        rows = classes.where("n > 0").select("id", "n", bands.alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("pivot")).where("members > 1").select("bucket", "pivot")
        self.buckets = stash(rows.join(shared, "bucket").select("bucket", "id", "n", "pivot"), "buckets")
        self.members = stash(self.buckets.select("id").distinct().join(classes.select("id", "n", "sketch"), "id"), "members")
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(self.members.select("id"), "id", "left_semi")
        self.sets = stash(shingle_table(texts, "id").dropDuplicates(["id"]), "sets")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs that pass the size bound and the estimate."""
        fits = pairs.where(f"{self.den} * least(na, nb) >= {self.num} * greatest(na, nb)").select("a", "b")
        a, b = (self.members.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
        return estimated(fits.join(a, "a").join(b, "b")).where(F.col("estimate") >= self.num / self.den - MARGIN).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        a, b = (self.sets.select(F.col("id").alias(x), F.col("shingles").alias(f"x{x}")) for x in "ab")
        both = F.size(F.array_intersect("xa", "xb"))
        return stash(pairs.join(a, "a").join(b, "b").where(self.den * both >= self.num * (F.size("xa") + F.size("xb") - both)).select("a", "b"), "links")

    def components(self) -> DataFrame:
        """``node, component`` of all linked classes."""
        sized = self.buckets.join(self.members.select(F.col("id").alias("pivot"), F.col("n").alias("np")), "pivot").where("id <> pivot").select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pivot").alias("a"), F.col("np").alias("na"))
        first = sized.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("p")).select("p.a", "b", "p.na", "p.nb")
        links = self.confirmed(self.near(first))
        found = connected_components(links)
        # every pivot whose component is another one still
        tried = first.select("a", "b")
        a, b = (found.toDF(x, f"c{x}") for x in "ab")
        open_pairs = sized.distinct().join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).join(tried, ["a", "b"], "left_anti")
        open_pairs = stash(open_pairs.select("a", "b", "na", "nb"), "open")
        more = self.confirmed(self.near(open_pairs))
        links = links.union(more)
        found = connected_components(links)
        # members of one bucket that aren't in one component
        labelled = self.buckets.join(found.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        left = stash(labelled.join(mixed, "bucket").select("id", "n", "label").distinct(), "mixed")
        return connected_components(links.union(self.confirmed(self.near(self.across(left).join(tried.union(open_pairs.select("a", "b")), ["a", "b"], "left_anti")))))

    def across(self, left: DataFrame) -> DataFrame:
        """Pairs of ``left`` with different labels that can reach the threshold.

        Only shingles that two labels hold count, and only texts with enough of those.  They are ranked from the fewest holders to the most,
        after a text's own shingles.  A pair of n and m shingles that reaches the threshold shares at least ``need`` of them, so its first
        common shingle is among the first n - need + 1 and m - need + 1.  A match that follows an earlier one is not a pair's first and is
        left out, as far as the ``BEFORE`` shingles in front of it tell.
        """
        held = self.sets.join(left, "id").select("id", "n", "label", F.explode("shingles").alias("shingle"))
        least = lambda n: F.ceil(n * self.num / self.den)
        for _ in range(2):
            often = held.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle", "holders")
            shared = held.drop("holders").join(often, "shingle")
            enough = shared.groupBy("id").agg(F.count("*").alias("shared"), F.first("n").alias("_n")).where(F.col("shared") >= least(F.col("_n"))).select("id", "shared")
            held = stash(shared.drop("shared").join(enough, "id"), "shared")
        ranked = held.groupBy("id", "n", "label", "shared").agg(F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("all"))
        own = F.col("n") - F.col("shared")
        reach = F.greatest(F.lit(0), F.col("n") - least(F.col("n")) + 1 - own).cast("int")
        spot = F.posexplode(F.transform(F.slice("all", F.lit(1), reach), lambda x, k: F.struct(x["shingle"].alias("shingle"), F.transform(F.slice("all", F.greatest(F.lit(1), k + 1 - BEFORE), F.least(k, F.lit(BEFORE))), lambda y: y["shingle"]).alias("before"))))
        prefix = stash(ranked.select("id", "n", "label", "shared", spot.alias("k", "x")).select("id", "n", "label", "shared", "x.shingle", "x.before", (F.col("n") - F.col("shared") + F.col("k") + 1).alias("place")), "prefix")
        x, y = (prefix.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "label", "shared", "place", "before")]) for s in "ab")
        x = x.where(F.col("place_a") <= F.col("n_a") - F.ceil(F.col("n_a") * (2 * self.num) / (self.num + self.den)) + 1)
        need = F.ceil((F.col("n_a") + F.col("n_b")) * self.num / (self.num + self.den))
        order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
        fits = order & (F.col("label_a") != F.col("label_b")) & (self.den * F.col("n_a") >= self.num * F.col("n_b")) & (F.least("shared_a", "shared_b") >= need)
        first = (F.col("place_a") <= F.col("n_a") - need + 1) & (F.col("place_b") <= F.col("n_b") - need + 1) & ~F.arrays_overlap("before_a", "before_b")
        found = x.join(y, (x.shingle == y.shingle) & fits & first)
        return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.when(F.col("id_a") < F.col("id_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("na"), F.when(F.col("id_a") < F.col("id_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("nb")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 75, denominator: int = 100) -> DataFrame:
    """One row an id: ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` (it is its component's smallest).

    Links join sets with ``denominator * intersection >= numerator * union``.
    """
    sketched = stash(sketches(docs, id_col, text_col), "sketches")
    members = sketched.select("id", "n", "low", "high")
    classes = stash(sketched.where("n > 0 and id is not null").groupBy("n", "low", "high").agg(F.min(F.struct("id", "sketch")).alias("s")).select("s.id", "n", "low", "high", "s.sketch"), "classes")
    found = _Finder(docs, classes, numerator, denominator, id_col, text_col).components()
    keys = classes.select("id", "n", "low", "high").join(found.toDF("id", "component"), "id", "left").select("n", "low", "high", F.coalesce("component", "id").alias("component"))
    out = members.join(keys, ["n", "low", "high"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each component; repeated rows of one id leave one row."""
    judged = stash(near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("kept").alias("_kept")), "judged")
    dropped = stash(judged.where(~F.col("_kept")).select("_id").distinct(), "dropped")
    repeated = stash(judged.where("_id is not null").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"), "repeated")
    rest = docs.join(dropped, F.col(id_col) == F.col("_id"), "left_anti")
    if not repeated.limit(1).count():
        return rest
    once = rest.join(repeated, F.col(id_col) == F.col("_id"), "left_semi").dropDuplicates([id_col])
    return rest.join(repeated, F.col(id_col) == F.col("_id"), "left_anti").unionByName(once)
