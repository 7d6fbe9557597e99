"""Problems 3 and 4 against brute force."""

import random
import re

import numpy as np

from lodestrand.llm import neardup, neighbours
from lodestrand.llm.pairs import components


def test_bands_reach_the_recall():
    for s in (0.5, 0.8):
        bands, width = neardup.bands_and_rows(s)
        assert 1 - (1 - s**width) ** bands >= neardup.RECALL


def notes():
    draw = random.Random(6)
    base = [[f"w{draw.randrange(400)}" for _ in range(40)] for _ in range(30)]
    out = []
    for k in range(120):
        words = list(base[k % 30])
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = "Edit"
        out.append((k, " ".join(words)))
    return out + [(200, out[0][1].upper()), (201, out[0][1] + " !"), (202, None), (203, ""), (204, "two words"), (205, out[0][1])]


def brute(data, width, least):
    sets = {}
    for k, t in data:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        if s:
            sets[k] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark):
    data = notes()
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in data], "id bigint, content string, grams string, n int")
    for width, least in ((3, 0.5), (5, 0.8)):
        got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", width, least).collect()}
        want = brute(data, width, least)
        assert got <= want and len(got) >= 0.99 * len(want) > 0
    assert neardup.near_duplicate_pairs(df.limit(0), "id", "content").count() == 0
    assert neardup.near_duplicate_pairs(df.union(df), "id", "content", 3, 0.5).count() == len({tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", 3, 0.5).collect()})


def test_classes_are_components(spark):
    data = notes()
    df = spark.createDataFrame(data, "id bigint, content string")
    got = {r.id: (r.class_id, r.links) for r in neardup.near_duplicate_classes(df, "id", "content", 3, 0.5).collect()}
    label = {k: k for k in got}
    for _ in range(50):
        for a, b in brute(data, 3, 0.5):
            label[a] = label[b] = min(label[a], label[b])
    assert {k: v[0] for k, v in got.items() if k not in (203, 204)} == {k: v for k, v in label.items() if k not in (203, 204)}
    assert got[200][1] == got[0][1] and 202 not in got and got[204] == (204, 0) and got[203] == (203, 0)


def test_grams_are_runs_of_words():
    texts = ["", "one two", "One, two_three\u00e9 four", "one two threeé FOUR!", "x" * 50, "\ud800 a b c", "İstanbul ist schön heute", "a b\nc"]
    draw = random.Random(2)
    texts += [" ".join(draw.choice("äßabc1") * draw.randrange(1, 9) for _ in range(60)) for _ in range(40)]
    for width in (1, 3, 5):
        sets = neardup.gram_sets(texts, width)
        names: dict = {}
        for t, s in zip(texts, sets):
            w = re.findall(r"[^\W_]+", t.lower())
            runs = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
            assert len(runs) == len(s) == len(set(s.tolist()))
            names[frozenset(runs)] = names.get(frozenset(runs), s.tobytes())
            assert names[frozenset(runs)] == s.tobytes()
        assert len(set(names.values())) == len(names)


def test_slices_change_nothing(monkeypatch):
    texts = [" ".join(f"w{(k * k + j) % 97}" for j in range(50)) for k in range(20)]
    want = [s.tobytes() for s in neardup.gram_sets(texts, 3)]
    monkeypatch.setattr(neardup, "SLICE", 64)
    assert [s.tobytes() for s in neardup.gram_sets(texts, 3)] == want


def test_copies_are_dropped_either_way(spark, monkeypatch):
    data = [(k, f"text {k % 4} with words") for k in range(10)] + [(20, "text 1 with words"), (20, "alone"), (21, None), (None, "x")]
    df = spark.createDataFrame(data, "id bigint, content string")
    want = sorted({(min(k for k, t in data if t == text and k is not None), text) for i, text in data if i is not None and text is not None})
    for most in (100, 0):
        monkeypatch.setattr(neardup, "DROPPED", most)
        for rows in (df, df.union(df)):
            member, texts = neardup.distinct_texts(rows, "id", "content")
            assert sorted(map(tuple, texts.collect())) == want and member.count() == 12
    assert neardup.distinct_texts(df.limit(0), "id", "content")[1].count() == 0


def test_ids_are_packed_whole():
    for ids in ([5], [-(1 << 63), (1 << 63) - 1, 0], [1000, 1255, 1256], [-3, 7, 7]):
        x = np.array(ids, np.int64)
        assert neardup._wide(neardup._narrow(x), len(x)).tolist() == ids


def test_a_shared_footer_makes_no_hot_bucket(spark, monkeypatch):
    """Rows of hot buckets are banded again, and nothing is lost."""
    monkeypatch.setattr(neardup, "HOT", 3)
    draw = random.Random(4)
    footer = " ".join(f"f{k}" for k in range(12))
    data = []
    for k in range(80):
        words = [f"u{draw.randrange(10**6)}" for _ in range(24)]
        data.append((2 * k, " ".join(words) + " " + footer))
        if k % 8 == 0:
            words[5] = "edit"
            data.append((2 * k + 1, " ".join(words) + " " + footer))
    data += [(1000 + k, "u1 u2 u3 u4 u5 u6 u7 u8 u9 " + f"v{k}") for k in range(12)] + [(2000 + k, data[0][1]) for k in range(9)]
    df = spark.createDataFrame(data, "id bigint, content string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", 3, 0.5).collect()}
    want = brute(data, 3, 0.5)
    assert got == want and len(want) > 100


def test_settled_ranges_lose_no_row(monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "RANGE_ROWS", 10)
    held, out = neardup._Range(2), []
    for k in range(40):
        out += list(held.add(np.array([1, 7, 100 + k // 2], np.uint32), np.array([k, 500 + k, 900 + k])))
    out += list(held.pairs())
    hot = [(r["bucket"] & 0xFFFFFFFF, r["a"]) for b in out for r in b.to_pylist() if r["b"] is None]
    pairs = {(r["a"], r["b"]) for b in out for r in b.to_pylist() if r["b"] is not None}
    assert sorted(hot) == sorted([(1, k) for k in range(40)] + [(7, 500 + k) for k in range(40)])
    assert pairs == {(900 + k, 901 + k) for k in range(0, 40, 2)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 40).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a bigint, b bigint"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and got[501] == 500


def vectors():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32))
    for k in range(0, 900, 3):
        x[k + 1] = x[k] * 3 + 0.25 * rng.standard_normal(32)
    data = [(f"v{k}", [float(v) for v in r], str(k)) for k, r in enumerate(x)]
    data += [("v0", data[0][1], "0"), ("copy", data[5][1], "9"), ("copy2", [2 * v for v in data[5][1]], "9")]
    return data + [("null", None, "1"), ("empty", [], "1"), ("short", [1.0] * 8, "1"), ("zero", [0.0] * 32, "1"), ("nan", [float("nan")] * 32, "1"), ("inf", [float("inf")] * 32, None), (None, [1.0] * 32, "3")]


def nearest(data, k):
    seen = {v: np.array(e) for v, e, _ in data if v and e and len(e) == 32 and np.isfinite(e).all() and np.any(e)}
    names = sorted(seen)
    m = np.stack([np.float32(seen[v]).astype(float) for v in names])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, -2)
    return {v: {names[j]: s[i, j] for j in np.argsort(-s[i], kind="stable")[:k]} for i, v in enumerate(names)}


def test_close_neighbours_against_brute_force(spark):
    data = vectors()
    df = spark.createDataFrame(data, "vid string, embedding array<float>, id string")
    got = {(r.a, r.b) for r in neighbours.close_neighbours(df, "vid", "embedding", 3, 0.85).collect()}
    want = {(a, b) for a, found in nearest(data, 3).items() for b, c in found.items() if c >= 0.85}
    assert len(want) > 500 and len(got & want) >= 0.99 * len(want) and got == want & got
    assert neighbours.close_neighbours(df.limit(0), "vid", "embedding").count() == 0
    assert neighbours.close_neighbours(df.where("vid = 'v3'"), "vid", "embedding").count() == 0


def test_stated_queries_reach_the_recall(spark):
    data = vectors()
    df = spark.createDataFrame(data, "vid string, embedding array<float>, id string")
    asked = df.where("try_cast(id as bigint) % 50 = 0")
    got: dict = {}
    for r in neighbours.nearest_for(df, asked, "vid", "embedding", 3).collect():
        got.setdefault(r.a, set()).add(r.b)
    want = nearest(data, 3)
    queries = {v for v, e, i in data if v in want and i is not None and int(i) % 50 == 0}
    hit = sum(len(got.get(a, set()) & want[a].keys()) for a in queries)
    assert got.keys() == queries and all(len(v) == 3 for v in got.values()) and hit >= 0.9 * 3 * len(queries)
    assert neighbours.nearest_for(df, asked.limit(0), "vid", "embedding").count() == 0


def copied():
    """A third of the rows are one vector at different lengths, and one id repeats on many rows."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 32))
    for k in range(0, 390, 3):
        x[k + 1] = x[k] + 0.2 * rng.standard_normal(32)
    data = [(f"v{k:03}", [float(v) for v in r]) for k, r in enumerate(x)]
    data += [(f"same{k:03}", [float(v) * (1 + k % 7) for v in x[0]]) for k in range(300)]
    return data + [("v003", data[3][1])] * 300


def test_copies_are_one_in_the_search(spark):
    data = copied()
    df = spark.createDataFrame(data, "vid string, embedding array<float>").repartition(2)
    distinct, owned = neighbours.distinct_vectors(neighbours.comparable(df, "vid", "embedding", 32), 32, 3)
    sizes = [len(r.heads) for r in distinct.collect()]
    assert max(sizes) == 4 and len(sizes) < 420 and owned.count() == 700
    got: dict = {}
    for r in neighbours.close_neighbours(df, "vid", "embedding", 3, 0.85).collect():
        got.setdefault(r.a, {})[r.b] = r.cosine
    assert all(len(f) == 3 and min(f.values()) > 0.9999999 for a, f in got.items() if a.startswith("same"))
    assert "v004" in got["v003"] and "v003" not in got["v003"]
    want = nearest([(v, e, "") for v, e in data if not v.startswith("same") and v not in ("v000", "v001")], 3)
    for v, f in want.items():
        assert got.get(v, {}).keys() == {b for b, c in f.items() if c >= 0.85}


def test_dense_clusters_keep_every_contender(spark):
    """More rows than any fixed number lie nearer to each other than bytes can tell apart."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(32)
    data = [(f"d{k:03}", [float(v) for v in centre + 0.004 * rng.standard_normal(32)], "") for k in range(240)]
    df = spark.createDataFrame(data, "vid string, embedding array<float>, id string")
    got: dict = {}
    for r in neighbours.close_neighbours(df, "vid", "embedding", 3, 0.85).collect():
        got.setdefault(r.a, set()).add(r.b)
    want = nearest(data, 3)
    assert sum(got[v] == f.keys() for v, f in want.items()) == len(data)


def test_equal_scores_keep_the_smaller_ids(spark):
    """80 vectors as equal as bytes can tell, all distinct: each has its 3 exact best."""
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(32)
    data = [(f"e{k:02}", [float(v) for v in centre + 0.0005 * rng.standard_normal(32)], "") for k in range(80)]
    df = spark.createDataFrame(data, "vid string, embedding array<float>, id string")
    got: dict = {}
    for r in neighbours.close_neighbours(df, "vid", "embedding", 3, 0.85).collect():
        got.setdefault(r.a, {})[r.b] = r.cosine
    want = nearest(data, 3)
    for v, f in want.items():
        assert len(got[v]) == 3 and min(got[v].values()) >= min(f.values()) - 1e-9


def test_large_cells_are_divided():
    """Subcells hold a table that has outgrown its coarse cells: every row once, and neighbours where queries look."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32)).astype(np.float32)
    x = centres[rng.integers(0, 40, 12_000)] + 0.3 * rng.standard_normal((12_000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = neighbours.fit(x[:4000], 12_000, 0.85)
    m.cells, m.group = m.cells[:2], m.group[:2]
    cell = m.coarse(x)
    near = np.repeat(np.arange(2)[None], 300, 0)
    owner = np.repeat(np.arange(300), 2)
    seen, scored, hits = [], 0, 0
    pairs: dict = {}
    for _, rows, asking in neighbours._divided(m, x, cell, x[:300], owner, near.ravel()):
        seen += rows.tolist()
        scored += len(rows) * len(asking)
        for q in asking.tolist():
            pairs.setdefault(q, set()).update(rows.tolist())
    assert len(seen) == len(set(seen)) and scored < 0.5 * 300 * 12_000
    exact = x[:300] @ x.T
    for q in range(300):
        exact[q, q] = -2
        hits += len(set(np.argsort(-exact[q])[:3].tolist()) & pairs[q])
    assert hits >= 0.9 * 900


def test_groups_split_by_counted_queries(spark, monkeypatch):
    data = vectors()
    df = spark.createDataFrame(data, "vid string, embedding array<float>, id string")
    want = {(r.a, r.b) for r in neighbours.close_neighbours(df, "vid", "embedding", 3, 0.85).collect()}
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 400)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 600)
    assert {(r.a, r.b) for r in neighbours.close_neighbours(df, "vid", "embedding", 3, 0.85).collect()} == want


def test_contenders_are_bounded_by_rounding():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, off = neighbours._unpacked(neighbours._packed(x).astype(np.float32))
    assert (np.arccos(np.clip((near * x).sum(1), -1, 1)) <= off).all() and off.max() < 0.03
    q, angle = np.array([1, 2, 1, 1, 1]), np.array([0.1, 0.5, 0.2, 0.11, 0.3])
    assert set(neighbours._contenders(q, angle, np.full(5, 0.01), 2)) == {0, 1, 3}
    assert set(neighbours._contenders(q, angle, np.full(5, 0.05), 2)) == {0, 1, 2, 3}


def test_stated_queries_count_copies_once(spark):
    data = copied()
    data += [(f"hot{k:03}", [2 * v for v in data[3][1]]) for k in range(300)]  # more than are reranked
    df = spark.createDataFrame(data, "vid string, embedding array<float>").coalesce(1)
    asked = df.where("vid in ('v003', 'v004', 'v007', 'same000')")
    got: dict = {}
    for r in neighbours.nearest_for(df, asked, "vid", "embedding", 3).collect():
        got.setdefault(r.a, {})[r.b] = r.cosine
    assert got.keys() == {"v003", "v004", "v007", "same000"} and all(len(f) == 3 for f in got.values())
    assert got["v003"].keys() == {"hot000", "hot001", "hot002"} and got["v004"].keys() == {"hot000", "hot001", "hot002"}
    assert "v006" in got["v007"] and min(got["same000"].values()) > 0.9999999
    once = df.where("vid not like 'hot%'")  # v003 stands on 301 rows
    got = {}
    for r in neighbours.nearest_for(once, asked, "vid", "embedding", 3).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert all(len(f) == 3 for f in got.values()) and "v004" in got["v003"] and "v003" in got["v004"]
