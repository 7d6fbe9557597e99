"""Problem 4: most similar vectors, by additive quantisation and exact reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import table

BOOKS, CODES, BEAM = 8, 16, 4  # residual codebooks over all dimensions, entries of each, beam of the encoding
FINE_BOOKS = 20  # codebooks where all rows are scored and only the best are reranked
CELL_ROWS = 400  # rows a coarse cell holds on average
MAX_CELLS = 16_384  # coarse centroids that every task holds at most; larger cells are divided again where they are searched
DIVIDED = 3 * CELL_ROWS  # rows from which a cell is divided into subcells of CELL_ROWS on average
SUB_PROBES = 3  # subcells a query looks into for each cell it probes: the nearest of all its cells of a task
SAMPLE = 131_072  # rows, drawn at random, that the codebooks are fitted on, about; every row is encoded and searched
PROBES = 14  # coarse cells a query looks into; a pair is found if either of its two looks into the other's cell
GROUP_ROWS = 25_000  # rows a group of neighbouring cells holds on average
BLOCK_ROWS, BLOCK_QUERIES = 60_000, 120_000  # of a group in one task; groups with more are split
SINGLE = 5e-4  # angle that single precision may miss of two nearly equal vectors
PAIR_BLOCK = 65_536  # pairs of vectors reranked at a time in a task
SCORE_BLOCK = 4_194_304  # table scores of rows and queries held at a time in a task
SAME = 2.0**-22  # grid on which unit vectors are compared: the same vector stored at different lengths falls on one point
QUERY_BLOCK = 32_768  # stated queries broadcast at a time, at most 4 * dim * QUERY_BLOCK bytes


@dataclass
class Quantiser:
    """cells: unit coarse centroids, group of each; books: residual codebooks; cut: least table score of a wanted pair."""

    cells: np.ndarray
    group: np.ndarray
    books: np.ndarray
    cut: float = -2.0

    def coarse(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i : i + 2048] @ self.cells.T).argmax(1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search over the residual books, and the norm of each reconstruction."""
        codes, norms = [], []
        for i in range(0, len(x), 2048):
            c, n = self._encode(x[i : i + 2048], self.cells[cell[i : i + 2048]])
            codes.append(c)
            norms.append(n)
        return (np.concatenate(codes), np.concatenate(norms)) if codes else (np.zeros((0, len(self.books)), np.uint8), np.zeros(0, np.float32))

    def _encode(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        rest = (x - start)[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        at = np.arange(n)[:, None]
        for book in self.books:
            wide = rest.shape[1]
            error = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(1)[None, None, :]
            flat = error.reshape(n, -1)
            keep = min(BEAM, wide * len(book))
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, code = best // len(book), best % len(book)
            rest = rest[at, parent] - book[code]
            codes = np.concatenate([codes[at, parent], code[:, :, None].astype(np.uint8)], axis=2)
        won = (rest**2).sum(2).argmin(1)
        here = np.arange(n)
        return codes[here, won], np.linalg.norm(x - rest[here, won], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Row BOOKS x CODES, column query: the dot product of each codebook entry with each query."""
        return self.books.reshape(-1, self.books.shape[2]) @ q.T

    def scores(self, tables: np.ndarray, base: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Estimated cosine of encoded rows (down) with queries (across), by table lookups. base: the rows' coarse part."""
        out = base.astype(np.float32, copy=True) if base.shape[0] == len(codes) else np.repeat(base, len(codes), axis=0)
        part = np.empty_like(out)
        for j in range(len(self.books)):
            np.take(tables, codes[:, j].astype(np.int64) + j * CODES, axis=0, out=part)
            out += part
        out /= np.maximum(norms, 1e-6)[:, None]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        label = np.concatenate([((x[i : i + 2048] @ centres.T) - (0 if unit else (centres**2).sum(1) / 2)).argmax(1) for i in range(0, len(x), 2048)])
        order = np.argsort(label, kind="stable")
        present, starts, sizes = np.unique(label[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        centres[present] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) if unit else sums / sizes[:, None]
        empty = np.setdiff1d(np.arange(k), present)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def fit(sample: np.ndarray, rows: int, min_cosine: float | None, depth: int = BOOKS) -> Quantiser:
    """Cells for rows vectors and codebooks, fitted on unit vectors of a sample."""
    rng = np.random.default_rng(7)
    cells = _kmeans(sample, int(min(MAX_CELLS, max(1, rows // CELL_ROWS), len(sample))), rng, True)
    groups = min(len(cells), max(1, round(rows / GROUP_ROWS)))
    group = (cells @ _kmeans(cells, groups, rng, True).T).argmax(1)
    q = Quantiser(cells, group, np.zeros((0, 0, sample.shape[1]), np.float32))
    part = sample[rng.choice(len(sample), min(len(sample), 16_384), replace=False)]
    rest = part - cells[q.coarse(part)]
    books = []
    for _ in range(depth):
        book = _kmeans(rest, CODES, rng, False)
        books.append(book)
        rest = rest - book[(rest @ book.T - (book**2).sum(1) / 2).argmax(1)]
    q.books = np.stack(books).astype(np.float32)
    if min_cosine is not None:
        x = part[:4096]  # queries made at the least wanted cosine from sample rows give the scores such pairs get
        noise = rng.standard_normal(x.shape).astype(np.float32)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        near = min_cosine * x + (1 - min_cosine**2) ** 0.5 * noise
        cell = q.coarse(x)
        codes, norms = q.encode(x, cell)
        estimate = (near * cells[cell]).sum(1) + sum((near * q.books[j][codes[:, j]]).sum(1) for j in range(depth))
        q.cut = float(np.quantile(estimate / np.maximum(norms, 1e-6), 0.001))
    return q


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None].astype(np.float32)


def comparable(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """(vid, vec): rows with an id and a vector of dim finite numbers that aren't all zero."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(ident).cast("string").alias("vid"), F.col(vector).cast("array<float>").alias("vec")).where(F.col("vid").isNotNull() & (F.size("vec") == dim)).where(fine)


def common_dimension(df: DataFrame, vector: str) -> int:
    """The length most vectors have (the smaller of equally frequent ones); 0 for an empty table."""
    top = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top[0] if top else 0


def _keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit vector on the grid."""
    grid = np.rint(x / np.float32(SAME)).astype(np.int32)
    return np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=8).digest() for r in grid), np.int64)


def _keyed(dim: int, kept: str):
    """(vid, vec) to the key and the kept one of both columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_keys(_unit(b.column(1), dim))), b.column(("vid", "vec").index(kept))], names=["key", kept])

    return run


def distinct_vectors(rows: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(key, heads, vec), one row per distinct vector, and (vid, key), one row per id.

    heads are the k + 1 smallest ids of the vector: enough to give every other vector, and each of
    its own ids, k of them. An id with several vectors keeps the one of the least key.
    """
    owned = rows.mapInArrow(_keyed(dim, "vid"), "key bigint, vid string").groupBy("vid").agg(F.min("key").alias("key"))
    at = Window.partitionBy("key").orderBy("vid")
    first = owned.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= k + 1)
    heads = first.groupBy("key").agg(F.sort_array(F.collect_list("vid")).alias("heads"))
    vecs = rows.mapInArrow(_keyed(dim, "vec"), "key bigint, vec array<float>").groupBy("key").agg(F.min("vec").alias("vec"))
    return vecs.join(heads.hint("merge"), "key").select("key", "heads", "vec"), owned


def _fitted(rows: DataFrame, dim: int, min_cosine: float | None, depth: int = BOOKS):
    n = rows.count()
    if n == 0:
        return None
    share = min(1.0, SAMPLE / n, max(32 * n / CELL_ROWS, 20_000) / n)
    held = rows.select("vec").sample(share, seed=11) if share < 1 else rows.select("vec")
    vectors = held.toArrow().column(0).combine_chunks()
    if len(vectors) == 0:
        vectors = rows.select("vec").limit(1).toArrow().column(0).combine_chunks()
    return rows.sparkSession.sparkContext.broadcast(fit(_unit(vectors, dim), n, min_cosine, depth))


ENTRY = "part int, is_query boolean, n int, blob binary"
_CELL = np.int16 if MAX_CELLS <= 1 << 15 else np.int32


def _probed(m: Quantiser, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's own cell; the cells it probes, sorted by group; which of these are the first of their group."""
    dots = x @ m.cells.T
    probes = min(PROBES, len(m.cells))
    near = np.argpartition(-dots, probes - 1, axis=1)[:, :probes]
    order = np.argsort(m.group[near], axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    groups = m.group[near]
    first = np.ones_like(groups, bool)
    first[:, 1:] = groups[:, 1:] != groups[:, :-1]
    return dots.argmax(1), near, first


def _entries(model, dim: int, blocks: dict[int, tuple[int, int, int]]):
    """A row into its own cell's group, and as a query into the groups of the cells it probes; packed by block, vectors as bytes.

    blocks: by group the number of its first block, and its blocks of queries and of rows. A query of a
    group with several blocks of rows goes to each of these, a row to each block of queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Quantiser = model.value
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                yield from one(m, b.slice(i, 8192))

    def packed(part: np.ndarray, row: np.ndarray, ids: np.ndarray, raw: np.ndarray, cells: np.ndarray, more: list[np.ndarray]) -> tuple[list, list, list]:
        order = np.argsort(part, kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        blobs, sizes = [], []
        for at in np.split(order, starts[1:]):
            fields = [ids[row[at]].tobytes(), raw[row[at]].tobytes(), (cells[at] >= 0).sum(1).astype(np.uint8).tobytes(), cells[at][cells[at] >= 0].astype(_CELL).tobytes(), *(f[row[at]].tobytes() for f in more)]
            blobs.append(b"".join(fields))
            sizes.append(len(at))
        return found.tolist(), sizes, blobs

    def one(m: Quantiser, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        x = _unit(b.column(1), dim)
        cell, near, first = _probed(m, x)
        codes, norms = m.encode(x, cell)
        raw = _packed(x)
        place = np.array([blocks.get(g, (0, 1, 1)) for g in range(int(m.group.max()) + 1)], np.int64)
        hashed = (ids.astype(np.int64).view(np.uint64) >> np.uint64(17)).astype(np.int64)
        row, at = np.nonzero(first)
        begin, nq, nx = place[m.group[near[row, at]]].T
        ends = np.append(np.flatnonzero(first)[1:], first.size) - row * first.shape[1]
        inside = (np.arange(first.shape[1]) >= at[:, None]) & (np.arange(first.shape[1]) < ends[:, None])
        cells = np.where(inside, near[row], -1)
        copies = np.repeat(np.arange(len(row)), nx)
        turn = np.arange(len(copies)) - np.repeat(np.cumsum(nx) - nx, nx)
        q = packed((begin + hashed[row] % nq * nx)[copies] + turn, row[copies], ids, raw, cells[copies], [])
        begin, nq, nx = place[m.group[cell]].T
        copies = np.repeat(np.arange(len(ids)), nq)
        turn = np.arange(len(copies)) - np.repeat(np.cumsum(nq) - nq, nq)
        r = packed((begin + hashed % nx)[copies] + turn * nx[copies], copies, ids, raw, cell[copies][:, None], [codes, norms.astype(np.float32)])
        for kind, (parts, sizes, blobs) in ((True, q), (False, r)):
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([kind] * len(parts)), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "is_query", "n", "blob"])

    return run


def _opened(kind: bool, n: int, blob: bytes, dim: int) -> tuple[np.ndarray, ...]:
    """ids, vectors as bytes, cells of each and how many, and for rows codes and norms."""
    at = 0

    def take(dtype, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype, count, at)
        at += out.nbytes
        return out

    ids, raw, many = take(np.int64, n), take(np.int8, n * dim).reshape(n, dim), take(np.uint8, n)
    cells = take(_CELL, int(many.sum()))
    return (ids, raw, many, cells) if kind else (ids, raw, many, cells, take(np.uint8, n * BOOKS).reshape(n, BOOKS), take(np.float32, n))


def _packed(x: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes, the largest coordinate at 127."""
    return np.clip(np.rint(x * 127 / np.abs(x).max(1, keepdims=True)), -127, 127).astype(np.int8)


def _unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of bytes, and the angle each may be away from the vector it was made of.

    Rounding moves a coordinate by half a step at most, so a vector by sqrt(dim) / 2 steps.
    """
    length, moved = np.linalg.norm(raw, axis=1, keepdims=True), raw.shape[1] ** 0.5 / 2
    return raw / length, np.arcsin(np.minimum(1, moved / np.maximum(length[:, 0] - moved, 1e-6))) + SINGLE


def _contenders(q: np.ndarray, angle: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that may be among the k best of their query; angle +- off bounds the exact angle."""
    if not len(q):
        return np.zeros(0, np.int64)
    order = np.lexsort((angle + off, q))
    begin = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
    size = np.diff(np.append(begin, len(q)))
    most = np.where(size >= k, (angle + off)[order][np.minimum(begin + k - 1, len(q) - 1)], np.inf)
    return order[(angle - off)[order] <= np.repeat(most, size)]


def _divided(m: Quantiser, raw: np.ndarray, cells: np.ndarray, q_raw: np.ndarray, owner: np.ndarray, probed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, rows, queries) to be scored. Small cells come whole; of large ones the subcells, each with the queries that have it among their nearest.

    cells: of each row; owner, probed: the queries and the cells they probe.
    """
    by_row, by_query = np.argsort(cells, kind="stable"), np.argsort(probed, kind="stable")
    present, starts = np.unique(cells[by_row], return_index=True)
    rng = np.random.default_rng(3)
    parts: list[tuple[int, np.ndarray]] = []
    asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for cell, rows in zip(present.tolist(), np.split(by_row, starts[1:])):
        lo, hi = np.searchsorted(probed[by_query], [cell, cell + 1])
        queries = owner[by_query[lo:hi]]
        if not len(queries):
            continue
        if len(rows) < DIVIDED:
            yield cell, rows, queries
            continue
        k = len(rows) // CELL_ROWS
        centres = _kmeans(raw[rng.choice(rows, min(len(rows), 32 * k), replace=False)], k, rng, True, 4)
        label = np.concatenate([(raw[rows[i : i + 4096]] @ centres.T).argmax(1) for i in range(0, len(rows), 4096)])
        keep = min(k, 4 * SUB_PROBES)
        for i in range(0, len(queries), 4096):
            q = queries[i : i + 4096]
            dots = q_raw[q] @ centres.T
            near = np.argpartition(-dots, keep - 1, axis=1)[:, :keep]
            asked.append((np.repeat(q, keep), near.ravel() + len(parts), np.take_along_axis(dots, near, 1).ravel()))
        parts += [(cell, rows[label == j]) for j in range(k)]
    if not asked:
        return
    q, part, dots = (np.concatenate(c) for c in zip(*asked))
    order = np.lexsort((-dots, q))
    q, part = q[order], part[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    big = np.isin(probed, [c for c in {c for c, _ in parts}])
    kept = rank < SUB_PROBES * np.bincount(owner[big], minlength=len(q_raw))[q]
    q, part = q[kept], part[kept]
    order = np.argsort(part, kind="stable")
    present, starts = np.unique(part[order], return_index=True)
    for k, queries in zip(present.tolist(), np.split(q[order], starts[1:])):
        if len(parts[k][1]):
            yield parts[k][0], parts[k][1], queries


def _search(model, dim: int, min_cosine: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Quantiser = model.value
        held: dict[int, list] = {}
        for b in batches:
            for part, kind, n, blob in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(part, []).append((kind, _opened(kind, n, blob, dim)))
        for part in sorted(held):
            rows, queries = ([f for kind, f in held[part] if kind is which] for which in (False, True))
            if rows and queries:
                yield one(m, [np.concatenate(c) for c in zip(*rows)], [np.concatenate(c) for c in zip(*queries)])
            held[part] = []

    def one(m: Quantiser, rows: list[np.ndarray], queries: list[np.ndarray]) -> pa.RecordBatch:
        ids, (raw, off), cells, codes, norms = rows[0], _unpacked(rows[1].astype(np.float32)), rows[3], rows[4], rows[5]
        q_ids, (q_raw, q_off) = queries[0], _unpacked(queries[1].astype(np.float32))
        owner = np.repeat(np.arange(len(q_ids)), queries[2])
        out_q, out_x, out_c, out_o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(0, np.float32)]
        for cell, here, asking in _divided(m, raw, cells, q_raw, owner, queries[3]):
            wide = min(1024, max(1, SCORE_BLOCK // len(here)))
            for i in range(0, len(asking), wide):
                q = asking[i : i + wide]
                vectors = q_raw[q]
                found = m.scores(m.tables(vectors), (vectors @ m.cells[cell])[None, :], codes[here], norms[here])
                r, c = np.nonzero(found >= m.cut)
                r, c = here[r], q[c]
                exact = np.concatenate([np.einsum("ij,ij->i", raw[r[j : j + PAIR_BLOCK]], q_raw[c[j : j + PAIR_BLOCK]]) for j in range(0, len(r), PAIR_BLOCK)] or [np.zeros(0, np.float32)])
                angle, away = np.arccos(np.clip(exact, -1, 1)), off[r] + q_off[c]
                fine = np.flatnonzero((angle - away <= np.arccos(min_cosine)) & (ids[r] != q_ids[c]))
                fine = fine[_contenders(q_ids[c[fine]], angle[fine], away[fine], k)]
                out_q.append(q_ids[c[fine]])
                out_x.append(ids[r[fine]])
                out_c.append(angle[fine])
                out_o.append(away[fine])
        q, x = np.concatenate(out_q), np.concatenate(out_x)
        kept = _contenders(q, np.concatenate(out_c), np.concatenate(out_o), k)
        return pa.RecordBatch.from_arrays([pa.array(q[kept]), pa.array(x[kept])], names=["a", "b"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.asarray(b.column(k).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1) for k in (2, 3))
            c = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.minimum(c, 1.0))], names=["a", "b", "cosine"])


def close_neighbours(df: DataFrame, ident: str, vector: str, k: int = 3, min_cosine: float = 0.85) -> DataFrame:
    """(a, b, cosine): for every id its k most similar other ids, as far as their cosine is at least min_cosine.

    Vectors that are null, empty, of another than the table's usual dimension, zero or not finite are
    neither queries nor neighbours. A repeated id counts once; of ties the smaller id comes first.
    The search runs between distinct vectors only; ids that share a vector are given each other at
    cosine 1 and are expanded from at most k + 1 of them after it.
    The first codebook's cells, one per CELL_ROWS rows, spread the work: a row is stored in its
    nearest cell, and looks into its PROBES nearest ones. Neighbouring cells form a group, so that
    a query travels once a group, as bytes; the rows and queries of each group are counted, and groups
    with many of either are split into blocks of both, one block a task. Where the table has outgrown
    MAX_CELLS, large cells are divided into subcells in the task, and queries go to the nearest of
    these. Within a cell table lookups score all rows for all queries; what reaches the
    score that pairs at min_cosine get is reranked by bytes: all that may be among the k best, as far
    as bytes can tell, are then reranked exactly on the stored vectors.
    """
    dim = common_dimension(df, vector)
    rows = comparable(df, ident, vector, dim)
    model = _fitted(rows, dim, min_cosine) if dim else None
    if model is None:
        return df.sparkSession.createDataFrame([], "a string, b string, cosine double")
    distinct, owned = distinct_vectors(rows, dim, k)
    hashed = distinct.select(F.col("key").alias("id"), "vec")
    blocks, total = _blocks(rows, model, dim)
    entries = hashed.mapInArrow(_entries(model, dim, blocks), ENTRY)
    found = entries.repartitionById(total, F.col("part")).mapInArrow(_search(model, dim, min_cosine, k), "a bigint, b bigint")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(distinct.toDF("a", "heads_a", "vec_a"), "a").join(distinct.toDF("b", "heads_b", "vec_b"), "b")
    cosines = both.select("heads_a", "heads_b", "vec_a", "vec_b").mapInArrow(_exact, "a array<string>, b array<string>, cosine double").where(F.col("cosine") >= min_cosine)
    ways = cosines.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w"), "cosine").select("w.a", "w.b", "cosine")
    near = Window.partitionBy(F.col("a")[0]).orderBy(F.desc("cosine"), F.col("b")[0])
    others = ways.where(F.size("a") <= k).withColumn("_at", F.row_number().over(near)).where(F.col("_at") <= k)
    one = others.select(F.explode("a").alias("a"), "b", "cosine").select("a", F.explode("b").alias("b"), "cosine")
    copies = distinct.select("key", "heads").where(F.size("heads") > 1)
    few = copies.where(F.size("heads") <= k).select(F.explode("heads").alias("a"), "heads")
    many = owned.join(copies.where(F.size("heads") > k), "key").select(F.col("vid").alias("a"), "heads")
    own = few.union(many).select("a", F.explode("heads").alias("b"), F.lit(1.0).alias("cosine")).where("a <> b")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return one.union(own).withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k).drop("_at")


def _blocks(rows: DataFrame, model, dim: int) -> tuple[dict[int, tuple[int, int, int]], int]:
    """By group the number of its first block and how many blocks of queries and of rows it has; all blocks.

    Queries and rows of each group are counted over all distinct vectors; one entry a group, of at most MAX_CELLS, reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Quantiser = model.value
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                x = _unit(b.column(1).slice(i, 8192), dim)
                cell, near, first = _probed(m, x)
                ends = np.append(0, np.cumsum(first.sum(1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(x)), pa.array(m.group[cell].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(m.group[near[first]].astype(np.int32)))], names=["key", "own", "asked"])

    held = rows.mapInArrow(run, "key bigint, own int, asked array<int>").groupBy("key").agg(F.min(F.struct("own", "asked")).alias("g"))
    each = held.select(F.explode(F.concat(F.transform("g.asked", lambda g: F.struct(g.alias("grp"), F.lit(1).alias("q"), F.lit(0).alias("x"))), F.array(F.struct(F.col("g.own").alias("grp"), F.lit(0).alias("q"), F.lit(1).alias("x"))))).alias("e"))
    blocks, total = {}, 0
    for g, q, x in each.groupBy("e.grp").agg(F.sum("e.q"), F.sum("e.x")).orderBy("grp").collect():
        nq, nx = max(1, -(-q // BLOCK_QUERIES)), max(1, -(-x // BLOCK_ROWS))
        blocks[g] = (total, nq, nx)
        total += nq * nx
    return blocks, max(1, total)


def nearest_for(df: DataFrame, queries: DataFrame, ident: str, vector: str, k: int = 3, rerank: int = 128) -> DataFrame:
    """(a, b, cosine): for the vectors of a stated query set their k most similar ids of the whole table.

    All distinct vectors are scored: each task encodes its own, scores them by table lookups for a
    block of queries, reranks its best rerank ones exactly, and keeps only k + 1 a query, which are
    shuffled once the task has seen all its rows (one may be the query's own). Ids that share a vector are expanded after it.
    Queries are broadcast in blocks of QUERY_BLOCK. Incomparable vectors are left out on both sides.
    """
    spark = df.sparkSession
    dim = common_dimension(df, vector)
    rows = comparable(df, ident, vector, dim)
    model = _fitted(rows, dim, None, FINE_BOOKS) if dim else None
    if model is None:
        return spark.createDataFrame([], "a string, b string, cosine double")
    asked = comparable(queries, ident, vector, dim).groupBy("vid").agg(F.min("vec").alias("vec"))
    distinct, _ = distinct_vectors(rows, dim, k)
    blocks = 1 + asked.count() // QUERY_BLOCK
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vid"), F.lit(blocks)) == block).toArrow()
        if part.num_rows == 0:
            continue
        held = spark.sparkContext.broadcast((part.column(0).to_pylist(), _unit(part.column(1).combine_chunks(), dim)))
        found = distinct.select("key", "heads", "vec").mapInArrow(_scan(model, held, dim, k, rerank), "a string, b array<string>, cosine double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "a string, b string, cosine double")
    near = Window.partitionBy("a").orderBy(F.desc("cosine"), F.col("b")[0])
    kept = out.withColumn("_at", F.row_number().over(near)).where(F.col("_at") <= k + 1)
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return kept.select("a", F.explode("b").alias("b"), "cosine").where("a <> b").withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k).drop("_at")


def _scan(model, held, dim: int, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Quantiser = model.value
        names, q = held.value
        tables, coarse = m.tables(q), m.cells @ q.T
        best: list[list] = [[] for _ in names]
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                heads = part.column(1).to_pylist()
                x = _unit(part.column(2), dim)
                cell = m.coarse(x)
                codes, norms = m.encode(x, cell)
                for j in range(0, len(names), 256):
                    found = m.scores(tables[:, j : j + 256], coarse[cell][:, j : j + 256], codes, norms).T
                    keep = min(max(rerank, k + 1), len(heads))
                    top = np.argpartition(-found, keep - 1, axis=1)[:, :keep]
                    exact = np.einsum("qd,qrd->qr", q[j : j + 256].astype(np.float64), x[top].astype(np.float64))
                    for n in range(len(top)):
                        best[j + n] = sorted([*best[j + n], *zip(-exact[n], (heads[r] for r in top[n]))])[: k + 1]
        a = [name for name, ranked in zip(names, best) for _ in ranked]
        c, s = [h for ranked in best for _, h in ranked], [-e for ranked in best for e, _ in ranked]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.list_(pa.string())), pa.array(s, pa.float64())], names=["a", "b", "cosine"])

    return run


def p4_found(spark, d):
    pairs = close_neighbours(table(spark, d, "vectors"), "vid", "embedding", 3, 0.85)
    return pairs.select(F.least("a", "b").alias("vid_a"), F.greatest("a", "b").alias("vid_b")).distinct()


def p4_neighbours(spark, d):
    """The three nearest of every vector whose ref_id is divisible by 50, among all rows."""
    rows = table(spark, d, "vectors")
    asked = rows.where(F.expr("try_cast(ref_id as bigint) % 50 = 0"))
    return nearest_for(rows, asked, "vid", "embedding", 3).select(F.col("a").alias("vid"), F.col("b").alias("neighbour"), F.round("cosine", 5).alias("cosine"))


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
SQL: dict[str, str] = {}
