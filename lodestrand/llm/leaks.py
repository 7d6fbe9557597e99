"""Problem 9: evaluation texts inside a corpus, by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.uniform import LOOKALIKES, uniform
from lodestrand.session import cut, table

SPAN = 12
MASKS = ("110111011011", "111010110111", "101101111101")  # 1: position counts, 0: it is ignored; all of SPAN positions
WORD = re.compile(r"[^\W_]+")
MISMATCH = -3.0  # a substituted word's score in a tolerant overlap, a match has 1
FILTER_BITS = 26  # the filter of item seeds that tasks hold has 2 ** FILTER_BITS bits (8 MB) for any number of items
SALTS = 32  # tasks over which the rows of a hot seed or item are spread


class _Words(dict):
    """Hashes of the words seen; a word's hash never depends on what else was seen."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def _one_letter() -> dict[int, str]:
    """What each letter becomes so that letters tied by their look, in either case, are one: B and its Cyrillic twin, hence their small letters."""
    tied: dict[str, str] = {}

    def root(c: str) -> str:
        while (up := tied.setdefault(c, c)) != c:
            c = up
        return c

    for group in LOOKALIKES:
        for c in group:
            first, other = sorted((root(group[0].lower()), root(c.lower())))
            tied[other] = first
    return {ord(c): root(c) for c in tied if root(c) != c}


ONE_LETTER = _one_letter()


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits of the text's one form, letters that look alike in either case taken as one.

    A word in capitals can be spelled wholly in another script, and which one is meant can't be told
    from the word; here it needn't, as both sides are brought to the same letters.
    """
    return WORD.findall(uniform(text).casefold().translate(ONE_LETTER))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word."""
    found = words(text)
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The masked hash of each window of SPAN words."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    multiplier = np.uint64(0xBF58476D1CE4E5B9)
    for at, counts in enumerate(mask):
        if counts == "1":
            out *= multiplier
            out += hashes[at : at + n]
            out ^= out >> np.uint64(29)
    return out


def _bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a seed in the filter."""
    left = np.uint64(64 - FILTER_BITS)
    return (s >> left).astype(np.int64), ((s * np.uint64(0x9E3779B97F4A7C15)) >> left).astype(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [(i, h) for i, h in zip(b.column(0).to_pylist(), map(word_hashes, b.column(1).to_pylist())) if len(h) >= SPAN]
        found = [np.concatenate([seeds(h, m, k) for k, m in enumerate(MASKS)]) for _, h in held]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([h.view(np.int64) for _, h in held], pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["item_id", "words", "seeds"])


def _filter(items: DataFrame) -> np.ndarray:
    """The places of all items' seeds, packed to bits. One filter of fixed size a partition of items reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            for at in _bits(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)):
                held[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in items.select("seeds").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r[0], np.uint8)
    return out


def _hits(held):
    """(id, text) to (row, doc_id, words, seeds, places) of texts with seeds that pass the filter; row is a digest of id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).view(bool)
        for b in batches:
            docs = [word_hashes(t) for t in b.column(1).to_pylist()]
            out: list[tuple] = []
            if docs:
                ends = np.cumsum([len(h) for h in docs])
                joined = np.concatenate(docs)
                found, where = [], []
                for k, mask in enumerate(MASKS):
                    s = seeds(joined, mask, k)
                    one, two = _bits(s)
                    at = np.flatnonzero(bits[one])
                    at = at[bits[two[at]]]
                    at = at[at + SPAN <= ends[np.searchsorted(ends, at, "right")]]
                    found.append(s[at].view(np.int64))
                    where.append(at)
                found, where = np.concatenate(found), np.concatenate(where)
                doc = np.searchsorted(ends, where, "right")
                order = np.argsort(doc, kind="stable")
                idents = b.column(0).to_pylist()
                begin = np.flatnonzero(np.append(True, np.diff(doc[order]) != 0)) if len(doc) else []
                for part in np.split(order, begin[1:]) if len(doc) else ():
                    d = int(doc[part[0]])
                    h = docs[d]
                    row = xxhash.xxh3_64_intdigest(h.tobytes(), seed=idents[d] & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                    out.append((row, idents[d], h.view(np.int64), found[part], (where[part] - (ends[d] - len(h))).astype(np.int32)))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["row", "doc_id", "words", "seeds", "places"])

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """On one diagonal: the longest exact run, and words matched and spanned by the best overlap with substitutions."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    run = longest = 0
    best = score = 0.0
    start, span = 0, (0, 0)
    for k, ok in enumerate(same.tolist()):
        run = run + 1 if ok else 0
        longest = max(longest, run)
        if score <= 0:
            score, start = 0.0, k
        score += 1 if ok else MISMATCH
        if score > best:
            best, span = score, (start, k + 1)
    return longest, int(same[span[0] : span[1]].sum()), span[1] - span[0]


def leaks(docs: DataFrame, ident: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, longest_run, matched, spanned): documents that hold passages of items.

    A row for each document and item that share a seed and an overlap of at least SPAN words with
    substitutions allowed; longest_run is the longest run of equal words. A run of SPAN equal words
    always shares every mask's seed, so none is missed. The corpus is scanned once; seeds of both sides
    are joined by a shuffle, to which only those go that pass a filter of fixed size, with the words of
    their documents. Hot seeds and items are spread over SALTS. Every diagonal of hits is then
    verified on the words. Any number of items will do: with very many the filter lets more through.
    Rows with null id or text, and texts of fewer than SPAN words, match nothing; repeated rows count once.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    queries = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    held = cut(queries.mapInArrow(_item_rows, "item_id bigint, words array<bigint>, seeds array<bigint>").withColumn("item", F.xxhash64("item_id", "words")))
    bits = spark.sparkContext.broadcast(_filter(held))
    found = cut(source.mapInArrow(_hits(bits), "row bigint, doc_id bigint, words array<bigint>, seeds array<bigint>, places array<int>"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    length = F.size("words") - (SPAN - 1)  # the seeds of an item stand mask by mask
    theirs = held.select("item", length.alias("n"), F.posexplode("seeds").alias("at", "seed")).select("item", "seed", (F.col("at") % F.col("n")).alias("q")).distinct().select("*", salts)
    ours = found.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("row", F.col("h.seeds").alias("seed"), F.col("h.places").alias("p"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    lines = ours.join(theirs, ["seed", "salt"]).select("row", "item", (F.col("p") - F.col("q")).alias("shift")).distinct().groupBy("row", "item").agg(F.collect_list("shift").alias("shifts"))
    texts = found.select("row", "doc_id", F.col("words").alias("doc")).dropDuplicates(["row"])
    names = held.select("item", "item_id", F.col("words").alias("words")).dropDuplicates(["item"]).select("*", salts)
    both = lines.join(texts, "row").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(names, ["item", "salt"])
    checked = both.select("doc_id", "item_id", "doc", "words", "shifts").mapInArrow(_verified, "doc_id bigint, item_id bigint, longest_run int, matched int, spanned int")
    return checked.where(f"spanned >= {SPAN} or longest_run >= {SPAN}")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, item = ([c.values.to_numpy(zero_copy_only=False) for c in b.column(k)] for k in (2, 3))
        best = [max(overlap(x, y, shift) for shift in shifts) for x, y, shifts in zip(doc, item, b.column(4).to_pylist())]
        columns = list(zip(*best)) or [()] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int32()) for c in columns)], names=["doc_id", "item_id", "longest_run", "matched", "spanned"])


def _all(spark, d):
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark, d):
    return _all(spark, d).where(f"longest_run >= {SPAN}").select("doc_id", "item_id").distinct()


def p9_overlaps(spark, d):
    return _all(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("longest_run").alias("longest_run"), F.max("matched").alias("matched"))


QUERIES = {"p9_found": p9_found, "p9_overlaps": p9_overlaps}
SQL: dict[str, str] = {}
