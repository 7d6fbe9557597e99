"""Problem 8: whole texts into containers of fixed token capacity, by cost-balanced packing."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut, table

CAPACITY = 2_048
RANKS = os.environ.get("LODESTRAND_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenising pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUTS = regex.compile(PATTERN)
LONG = 500_000  # characters from which a text is cut here and counted piece by piece, to the same sum
GROUP_TOKENS = 4_000_000  # of whole items packed by one task
_counters: dict[int, TokenCounter] = {}


class TokenCounter:
    """Exact tokens of a text in a rank file's vocabulary, given as the file's bytes."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> int:
        if len(text) < LONG:
            return len(self.encode(text))
        return sum(len(self.encode(m[0])) for m in CUTS.finditer(text))  # the library's own cutting recurses too deep there


def token_counts(df: DataFrame, ident: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(id, n_tokens): exact tokens of every whole text; null counts as 0.

    The driver reads the rank file (a vocabulary, of fixed size) and sends it with the job: no worker needs the path.
    """
    with open(ranks, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if (count := _counters.get(key)) is None:
            count = _counters[key] = TokenCounter(sent.value)
        for b in batches:
            sizes = [count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    src = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    return src.mapInArrow(run, "id bigint, n_tokens bigint")


def cost(n: int, capacity: int) -> float:
    """Linear work plus quadratic attention of a text of n tokens, equal for a full container."""
    return n + n * n / capacity


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """The container of each of sizes, which come in descending order and are at most capacity.

    A container for each capacity of tokens is open from the start. Each item goes to the open
    container of lowest cost that has room, found in a tournament tree over remaining room; only
    if none has room a further one is opened.
    """
    leaves = 1
    while leaves <= capacity:
        leaves *= 2
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    none = (float("inf"), -1, -1)
    tree = [none] * (2 * leaves)

    def renew(room: int) -> None:
        at = leaves + room
        tree[at] = (*heaps[room][0], room) if heaps[room] else none
        at //= 2
        while at:
            new = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == new:
                break
            tree[at] = new
            at //= 2

    opened = -(-sum(sizes) // capacity)
    heaps[capacity] = [(0.0, k) for k in range(opened)]
    renew(capacity)
    out = []
    for n in sizes:
        lo, hi, best = leaves + n, 2 * leaves, none
        while lo < hi:  # the cheapest over rooms n ... capacity
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo //= 2
            hi //= 2
        spent, at, room = best
        if at < 0:
            spent, at, room = 0.0, opened, capacity
            opened += 1
        else:
            heapq.heappop(heaps[room])
            renew(room)
        heapq.heappush(heaps[room - n], (spent + cost(n, capacity), at))
        renew(room - n)
        out.append(at)
    return out


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(id, piece, pieces, start, n_tokens, container) for sizes (id, n_tokens).

    A text larger than the capacity is split into full containers and a rest; all others stay whole.
    Items are spread by a hash of id and piece over groups of about group_tokens tokens, packed
    independently: tasks stay bounded at any size, and at most about one container in
    group_tokens / capacity is left partly empty by the split. Empty texts take no room and no
    container (container null); repeated rows are packed each.
    """
    pieces = sizes.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")).select(
        "id", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "n_tokens"
    ).select("id", "piece", "pieces", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    groups = 1 + total // group_tokens

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        full = int((rows["n_tokens"] >= capacity).sum())
        rest = pack_sizes(rows["n_tokens"].iloc[full:].tolist(), capacity)
        base = int(key[0]) << 32
        rows["container"] = [base + k for k in range(full)] + [base + full + k for k in rest]
        return rows[["id", "piece", "pieces", "start", "n_tokens", "container"]]

    schema = "id bigint, piece int, pieces int, start bigint, n_tokens bigint, container bigint"
    placed = pieces.where("n_tokens > 0").withColumn("grp", F.pmod(F.xxhash64("id", "piece"), F.lit(groups))).groupBy("grp").applyInPandas(run, schema)
    return placed.union(pieces.where("n_tokens <= 0").select("id", "piece", "pieces", "start", "n_tokens", F.lit(None).cast("bigint").alias("container")))


def _packed(spark, d):
    return pack(cut(token_counts(table(spark, d, "documents"), "doc_id", "text")))


def p8_found(spark, d):
    return _packed(spark, d).where("pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p8_packed(spark, d):
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p8_fill(spark, d):
    """Containers, tokens and the share of room used."""
    used = _packed(spark, d).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    return used.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.max("k").alias("most_items"), F.round(F.sum("n") / (F.count("*") * CAPACITY), 4).alias("fill"))


QUERIES = {"p8_found": p8_found, "p8_packed": p8_packed, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
