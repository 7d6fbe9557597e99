"""Shared by the pair operators: salted self joins, connected components, and near duplicates by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import vectors
from lodestrand.session import cut

BLOCK = 2_000  # rows of one key that one task pairs with the key's rows at a time


def salted_pairs(rows: DataFrame, key: str, ident: str, carried: list[str], condition: str, block: int = BLOCK, differing: str | None = None) -> DataFrame:
    """Pairs a, b of rows with the same key and a.ident < b.ident that meet condition.

    A key with n rows is spread over ceil(n / block) salts: each left row goes to one, each right
    row to all of them, so no task holds more than about block x n pairs of a hot key. Columns come
    out as <name>_a and <name>_b; condition is SQL over these. Keys whose rows all have one value of
    differing are left out before any pairing.
    """
    spread = [F.min(differing).alias("_lo"), F.max(differing).alias("_hi")] if differing else []
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), *spread).where("_n > 1" + " and _lo <> _hi" * bool(differing)).select(key, F.ceil(F.col("_n") / block).cast("int").alias("_salts"))
    kept = rows.select(key, ident, *carried).join(sizes, key)
    left = kept.select(key, F.pmod(F.xxhash64(ident), F.col("_salts")).cast("int").alias("_salt"), *(F.col(c).alias(f"{c}_a") for c in (ident, *carried)))
    right = kept.select(key, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), *(F.col(c).alias(f"{c}_b") for c in (ident, *carried)))
    return left.join(right, [key, "_salt"]).where(f"{ident}_a < {ident}_b and ({condition})").select(*(f"{c}_{s}" for c in (ident, *carried) for s in "ab"))


def expanded(links: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b): links (a, b) between representatives, with every member (rep, id) of both sides in their places.

    members lists the members of representatives that have several, themselves included; other
    representatives stand for themselves. A representative with n members is spread over
    ceil(n / block) salts, so that no task joins a hot one alone.
    """
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("_salts"))
    held = members.join(sizes, "rep").select("rep", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int").alias("_salt"), "id")

    def side(pairs: DataFrame, name: str) -> DataFrame:
        salted = pairs.join(sizes.withColumnRenamed("rep", name), name, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
        got = salted.join(held.withColumnRenamed("rep", name), [name, "_salt"], "left")
        return got.select(*(F.coalesce("id", c).alias(c) if c == name else c for c in ("a", "b")))

    return side(side(links.select("a", "b"), "a"), "b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating star contraction.

    Every round cuts lineage with a reliable checkpoint and about halves what is left; it ends once
    nothing changes. Should rounds not suffice, it raises instead of giving unfinished classes.
    """
    both = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    links = cut(both)
    before = _state(links)
    for _ in range(rounds):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour or itself
        ways = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("o")), F.struct(F.col("v").alias("n"), F.col("u").alias("o")))).alias("e")
        sym = links.select(ways).select("e.n", "e.o")
        low = sym.groupBy("n").agg(F.min("o").alias("lo")).select("n", F.least("n", "lo").alias("m"))
        large = cut(sym.join(low, "n").where("o > n and m < o").select(F.col("m").alias("u"), F.col("o").alias("v")).distinct())
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        tied = large.join(least, "v").select("m", F.explode(F.array("u", "v")).alias("o"))
        links = cut(tied.where("m < o").select(F.col("m").alias("u"), F.col("o").alias("v")).distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    labels = links.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.col("u").alias("c")), F.struct(F.col("u").alias("node"), F.col("u").alias("c")))).alias("e"))
    return labels.groupBy("e.node").agg(F.min("e.c").alias("component"))


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def near_duplicate_vectors(df: DataFrame, ident: str, vector: str, planes: list[list[float]], min_cosine: float) -> DataFrame:
    """(ident, class_id, links): for every row how many others share a bucket with it at a cosine of at least min_cosine.

    Rows tied by links, directly or through others, have the least of their ids as class. Equal
    vectors are one representative in the bucket join, which is salted, and are expanded after it.
    Zero vectors and nulls have no links.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(vector).alias("vec"))
    usable = rows.where(F.exists("vec", lambda x: x != 0))
    distinct = cut(usable.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    signed = distinct.withColumn("signature", vectors.simhash(F.col("vec"), planes))
    each = signed.select("rep", "vec", "copies", F.posexplode(vectors.buckets(F.col("signature"))).alias("h", "bucket"))
    keyed = each.select(F.struct("h", "bucket").alias("key"), "rep", "vec", "copies")
    close = salted_pairs(keyed, "key", "rep", ["vec", "copies"], "true").where(vectors.cosine(F.col("vec_a"), F.col("vec_b")) >= min_cosine)
    pairs = cut(close.select("rep_a", "rep_b", "copies_a", "copies_b").distinct())
    ways = F.explode(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("copies_b").alias("n")), F.struct(F.col("rep_b").alias("rep"), F.col("copies_a").alias("n")))).alias("w")
    links = pairs.select(ways).groupBy("w.rep").agg(F.sum("w.n").alias("others"))
    tied = components(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    found = distinct.join(links, "rep", "left").join(tied, "rep", "left")
    found = found.select("vec", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(found, "vec", "left")
    return out.select(F.col("id").alias(ident), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
