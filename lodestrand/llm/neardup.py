"""Problem 3: near-duplicate records, by MinHash banding and verification on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.pairs import components, expanded, salted_pairs
from lodestrand.session import cut, slots, table

RECALL = 0.995
LONGEST, LONGEST_AGAIN = 512, 2_048  # hashes of a signature at most; of the wider one for rows of hot buckets
HOT = 32  # rows of a bucket from which its rows are banded again more selectively
RANGE_ROWS = 4_000_000  # band hashes a task sorts at a time, in a range of hashes of its own
DROPPED = 200_000  # copies, of 40 bytes each, that are sent to the tasks to be dropped from a scan
SLICE = 1_000_000  # characters hashed, or pairs sent, at a time
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def bands_and_rows(similarity: float, recall: float = RECALL, longest: int = LONGEST) -> tuple[int, int]:
    """Bands and rows a band for at least recall at similarity: the most rows for which the signature stays within longest hashes."""
    for rows in range(16, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 0.999999) ** rows)))
        if bands * rows <= longest:
            return bands, rows
    raise ValueError(f"a similarity of {similarity} needs more than {longest} hashes for a recall of {recall}")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class _Letters:
    """For each code point whether it belongs to a word; powers of the hash base and of its inverse."""

    def __init__(self) -> None:
        self.letters, self.known = np.zeros(0x110000, bool), np.zeros(0x1100, bool)
        base, inverse = int(_ODD), pow(int(_ODD), -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(SLICE + 64, b, np.uint64))) for b in (base, inverse))


    def inside(self, codes: np.ndarray) -> np.ndarray:
        blocks = np.flatnonzero(np.bincount(codes >> 8, minlength=0x1100))
        for block in blocks[~self.known[blocks]].tolist():  # filled as they are met
            self.letters[block << 8 : (block + 1) << 8] = [chr(c).isalnum() for c in range(block << 8, (block + 1) << 8)]
            self.known[block] = True
        return self.letters[codes]


_letters: list[_Letters] = []


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of each word, a run of letters and digits of text; text is cut at SLICE characters between words."""
    if not _letters:
        _letters.append(_Letters())
    known = _letters[0]
    hashes, places, at = [], [], 0
    while at < len(text):
        stop = min(len(text), at + SLICE)
        while at + 1 < stop < len(text) and text[stop - 1].isalnum() and text[stop].isalnum():
            stop -= 1
            if stop == at + 1:  # one word longer than a slice: taken by its parts
                stop = min(len(text), at + SLICE)
                break
        codes = np.frombuffer(text[at:stop].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = known.inside(codes)
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(codes.astype(np.uint64) + _ODD) * known.up[: len(codes)])])
        hashes.append(_mixed((sums[end] - sums[begin]) * known.down[begin]))
        places.append(begin + at)
        at = stop
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gram_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of all runs of width lower-cased words; none where there are fewer words."""
    lowered = [t.lower() for t in texts]
    out: list[np.ndarray] = []
    for first, last in _spans([len(t) for t in lowered]):
        part = lowered[first:last]
        hashes, places = word_hashes("\n".join(part))
        bounds = np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in part)]))
        n = max(0, len(hashes) - width + 1)
        runs = hashes[:n].copy()
        for k in range(1, width):
            runs = _mixed(runs) + hashes[k : k + n]
        runs = _mixed(runs)
        out += [np.unique(runs[a : max(a, b - width + 1)]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return out


def _spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items of about SLICE in all."""
    first = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > SLICE:
            yield first, k
            first, held = k, 0
        held += n + 1
    if sizes:
        yield first, len(sizes)


class Bands:
    """A hash for each MinHash band of an n-gram set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_501 + rows)
        self.shape = bands, rows
        self.odd = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sets down, bands across; every set has members."""
        bands, rows = self.shape
        low = np.empty((len(sets), bands * rows), np.uint32)
        for k, s in enumerate(sets):
            short = (s >> np.uint64(32)).astype(np.uint32)
            low[k] = (short[:4096, None] * self.odd + self.plus).min(0)
            for at in range(4096, len(s), 4096):  # long texts in slices, all of them
                np.minimum(low[k], (short[at : at + 4096, None] * self.odd + self.plus).min(0), out=low[k])
        low = low.reshape(len(sets), bands, rows)
        out = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _ODD, (len(sets), bands))
        for r in range(rows):
            out = _mixed(out + low[:, :, r])
        return out * _ODD


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as offsets from the least, in as few bytes as they need: the least, the width, the offsets."""
    least = ids.min()
    off = (ids - least).view(np.uint64)
    width = max(1, (int(off.max()).bit_length() + 7) // 8)
    return int(least).to_bytes(8, "little", signed=True) + bytes([width]) + off.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, : blob[8]] = np.frombuffer(blob, np.uint8, offset=9).reshape(n, blob[8])
    with np.errstate(over="ignore"):
        return raw.view(np.int64)[:, 0] + int.from_bytes(blob[:8], "little", signed=True)


def _banded(width: int, bands: int, rows: int, ranges: int):
    """(id, text) to (range, blob): the band hashes of many rows that fall into a range of hashes, packed with the rows' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = Bands(bands, rows)
        for b in batches:
            sets = gram_sets(b.column(1).to_pylist(), width)
            some = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
            for at in range(0, len(some), 16_384):
                part = some[at : at + 16_384]
                hashes = signature([sets[k] for k in part]).ravel()
                ids = np.repeat(b.column(0).to_numpy()[part], bands)
                to = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                found, starts = np.unique(to[order], return_index=True)
                blobs = []
                for place in np.split(order, starts[1:]):
                    blobs.append(hashes[place].astype(np.uint32).tobytes() + _narrow(ids[place]))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.diff(np.append(starts, len(order))).astype(np.int32)), pa.array(blobs, pa.binary())], names=["range", "n", "blob"])

    return run


FOUND = "bucket bigint, a bigint, b bigint"


def _rows(bucket: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(a), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], names=["bucket", "a", "b"])


class _Range:
    """The rows of one range of hashes. Memory stays bounded: a bucket of more than HOT rows is passed on row by row, with what still comes for it."""

    def __init__(self, number: int):
        self.number, self.hot = number, np.zeros(0, np.uint32)
        self.hashes: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(self.hot) and (late := np.isin(hashes, self.hot)).any():
            yield self.passed(hashes[late], ids[late])
            hashes, ids = hashes[~late], ids[~late]
        self.hashes.append(hashes)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held > 2 * RANGE_ROWS:
            yield from self.settle()

    def passed(self, hashes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return _rows(hashes.astype(np.int64) | np.int64(self.number << 32), ids, None)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Sort what is held and pass hot buckets on."""
        hashes = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint32)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        self.starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.starts, len(hashes)))
        if (self.sizes > HOT).any():
            many = np.repeat(self.sizes > HOT, self.sizes)
            yield self.passed(hashes[many], ids[many])
            self.hot = np.union1d(self.hot, hashes[many])
            hashes, ids = hashes[~many], ids[~many]
            self.sizes = self.sizes[self.sizes <= HOT]
            self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes, self.ids, self.held = [hashes], [ids], len(ids)

    def pairs(self) -> Iterator[pa.RecordBatch]:
        yield from self.settle()
        ids = self.ids[0]
        for size in np.unique(self.sizes[self.sizes > 1]).tolist():
            starts = self.starts[self.sizes == size]
            left, right = np.triu_indices(size, 1)
            step = max(1, SLICE // len(left))
            for k in range(0, len(starts), step):
                members = ids[starts[k : k + step, None] + np.arange(size)]
                x, y = members[:, left].ravel(), members[:, right].ravel()
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                both = both[both[:, 0] < both[:, 1]]
                yield _rows(np.zeros(len(both), np.int64), both[:, 0].copy(), both[:, 1].copy())


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each bucket of at most HOT rows; of larger ones the rows, with no second id."""
    ranges: dict[int, _Range] = {}
    for b in batches:
        for number, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            held = ranges.setdefault(number, _Range(number))
            yield from held.add(np.frombuffer(blob, np.uint32, n), _wide(blob[4 * n :], n))
    for held in ranges.values():
        yield from held.pairs()


def _candidates(texts: DataFrame, width: int, similarity: float, longest: int) -> DataFrame:
    """(bucket, a, b) of rows that share a band; b is null for the rows of hot buckets. Materialised."""
    bands, rows = bands_and_rows(similarity, longest=longest)
    ranges = max(slots(texts.sparkSession), -(-texts.count() * bands // RANGE_ROWS))
    blobs = texts.mapInArrow(_banded(width, bands, rows, ranges), "range int, n int, blob binary")
    return cut(blobs.repartitionById(ranges, F.col("range")).mapInArrow(_paired, FOUND))


def _grams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in gram_sets(b.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "grams"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs, ys = ([c.values.to_numpy(zero_copy_only=False) for c in b.column(k)] for k in (2, 3))
        shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys)]
        share = [s / (len(x) + len(y) - s) for s, x, y in zip(shared, xs, ys)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64())], names=["a", "b", "similarity"])


def _texts(df: DataFrame, ident: str, text: str) -> DataFrame:
    return df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")


def distinct_texts(df: DataFrame, ident: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row with id and text, rep the least id with the same text, and (id, text) of those.

    Digests are aggregated before they are shuffled. Where at most DROPPED rows are copies, which is
    counted, these are sent to the tasks and dropped from the scan; else texts meet in partial aggregates
    by digest, are shuffled once and stored. Repeated rows count once; an id with several texts stands
    for each of them.
    """
    src = _texts(df, ident, text).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = src.select("id", "digest")
    firsts = keyed.groupBy("digest").agg(F.min("id").alias("rep"))
    member = cut(keyed.groupBy("id", "digest").agg(F.count("*").alias("n")).join(firsts, "digest"))
    most, copies = member.agg(F.max("n"), F.count(F.when(F.col("id") != F.col("rep"), 1))).first()
    if copies <= DROPPED and (most or 1) == 1:
        copied = member.where("id <> rep").select("id", "digest")
        return member.select("id", "rep").distinct(), src.join(F.broadcast(copied), ["id", "digest"], "left_anti").select("id", "text")
    return member.select("id", "rep").distinct(), cut(src.groupBy("digest").agg(F.min("id").alias("id"), F.first("text").alias("text")).select("id", "text"))


def _compared(texts: DataFrame, width: int, similarity: float, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """similar_pairs, and (id, grams) of the texts compared and of also (id)."""
    found = _candidates(texts, width, similarity, LONGEST)
    pairs = found.where("b is not null").select("a", "b")
    hot = found.where("b is null").select(F.col("a").alias("id")).distinct()
    if not hot.isEmpty():
        again = _candidates(texts.join(hot, "id", "left_semi"), width, similarity, LONGEST_AGAIN)
        close = salted_pairs(again.where("b is null").select("bucket", F.col("a").alias("id")).distinct(), "bucket", "id", [], "true")
        pairs = pairs.union(again.where("b is not null").select("a", "b")).union(close.select("id_a", "id_b"))
    pairs = cut(pairs.distinct())
    touched = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    touched = (touched.union(also) if also is not None else touched).distinct()
    sets = cut(texts.join(touched, "id", "left_semi").select("id", "text").mapInArrow(_grams(width), "id bigint, grams array<bigint>"))
    both = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
    return both.select("a", "b", "grams_a", "grams_b").mapInArrow(_shared, "a bigint, b bigint, similarity double").where(F.col("similarity") >= similarity), sets


def similar_pairs(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows (id, text) that are at least so similar.

    Band hashes are shuffled to ranges of hashes, packed with the ids of their rows and without texts; a task sorts
    its range and pairs the rows of each bucket. Text that very many rows share (a footer, a licence)
    makes hot buckets: their rows are banded a second time, by more rows a band for the same recall,
    where such rows part; what still shares a bucket is paired through salts. Every candidate pair is
    then verified once on the full sets. No cap on partners or candidates. Texts of fewer than width
    words have no set and no pairs.
    """
    return _compared(texts, width, similarity)[0]


def near_duplicate_links(df: DataFrame, ident: str, text: str, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different texts at least so similar, each text by the least id that has it.

    Which other ids have the text stands in near_duplicate_classes (copy_of): together the whole result
    without expanding copies.
    """
    return similar_pairs(distinct_texts(df, ident, text)[1], width, similarity)


def near_duplicate_pairs(df: DataFrame, ident: str, text: str, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of rows at least so similar, copies of one text included.

    The similarity join runs between different texts only; copies are expanded after it, through
    salts. Rows with null id or text, and texts of fewer than width words, are in no pair.
    """
    member, texts = distinct_texts(df, ident, text)
    several = cut(member.join(member.where("id <> rep").select("rep").distinct(), "rep", "left_semi"))
    links, sets = _compared(texts, width, similarity, several.select(F.col("rep").alias("id")))
    across = expanded(links.select("a", "b"), several)
    told = sets.where("size(grams) > 0").select(F.col("id").alias("rep"))
    within = salted_pairs(several.join(told, "rep", "left_semi"), "rep", "id", [], "true").select("id_a", "id_b")
    both = across.union(within).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def near_duplicate_classes(df: DataFrame, ident: str, text: str, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, copy_of, class_id, links): one row per id with a text: the least id with its text, its class's least id, its number of links.

    Links are counted between different texts; copies have their text's. Rows without similar ones,
    empty and short texts among them, are a class of their own text, with 0 links.
    """
    member, texts = distinct_texts(df, ident, text)
    links = cut(similar_pairs(texts, width, similarity).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = components(links).select(F.col("node").alias("rep"), "component")
    tied = groups.join(degree, "rep")
    return member.join(tied, "rep", "left").select("id", F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark, d):
    return near_duplicate_pairs(table(spark, d, "snapshots"), "id", "content", 3, 0.5)


def p3_classes(spark, d):
    return near_duplicate_classes(table(spark, d, "snapshots"), "id", "content", 3, 0.5)


def p3_links(spark, d):
    return near_duplicate_links(table(spark, d, "snapshots"), "id", "content", 3, 0.5)


def p3_titles(spark, d):
    """Classes by content with how many titles each has."""
    rows = table(spark, d, "snapshots")
    return p3_classes(spark, d).where("id <> class_id or copy_of <> id or links > 0").join(rows.select("id", "title"), "id").groupBy("class_id").agg(F.count("*").alias("notes"), F.countDistinct("title").alias("titles"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_links": p3_links, "p3_titles": p3_titles}
SQL: dict[str, str] = {}
