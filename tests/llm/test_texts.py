"""Problems 9, 10, 8 and 6 on small fixtures."""

import random

import pytest

from lodestrand.llm import leaks, looks, packing, terms
from lodestrand.llm.uniform import resolve, uniform


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("other", ["ｐａｙ the bill", "pаy the bill", "pay​ the bill", "pay the bill", "pay the bill⁠", "pау the bill"])
def test_same_look_same_form(other):
    assert uniform(other) == "pay the bill"


@pytest.mark.parametrize("other", ["Pay the bill", "páy the bill", "pay the bi11", "pay the² bill", "pay  the bill"])
def test_real_differences_stay(other):
    assert uniform(other) != "pay the bill"


def test_scripts():
    assert uniform("кот и cоль") == "кот и соль"  # the Latin c of a Cyrillic word
    assert uniform("соре") == "cope"  # a whole-script look-alike without other letters reads as Latin
    assert uniform("Привет, соре") == "Привет, соре"  # in a Cyrillic text it reads as Cyrillic
    assert resolve("xИ", "LATIN") == uniform("хИ") == "хИ"
    assert uniform("café") == "café" and uniform("ёж") == "ёж"
    assert uniform(None) is None and uniform("") == "" and uniform("a \r\nb\t") == "a\nb"


def test_long_text_is_taken_whole():
    text = "слово " * 200_000 + "cлово"
    assert uniform(text) == "слово " * 200_000 + "слово"


def test_same_look_pairs(spark):
    docs = spark.createDataFrame(
        [(1, "pay now", "x"), (2, "pаy now", "x"), (3, "pay now", "x"), (4, None, "x"), (5, "", "x"), (6, "​", None), (7, "Pay now", "x"), (None, "pаy now", "x"), (2, "pаy now", "x")], "doc_id bigint, text string, form_key string")
    assert rows(looks.same_look_pairs(docs, "doc_id", "text"), "a", "b") == [(1, 2), (2, 3), (5, 6)]
    assert rows(looks.look_classes(docs, "doc_id", "text").distinct(), "id", "class_id") == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    forms = {r["id"]: (r["form"], r["changed"]) for r in looks.uniform_texts(docs, "doc_id", "text").where("id is not null").collect()}
    assert forms[4] == (None, False) and forms[2] == ("pay now", True) and forms[1] == ("pay now", False)
    assert looks.same_look_pairs(docs.limit(0), "doc_id", "text").count() == 0


def test_hot_form_is_salted(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "concat('same', repeat('​', cast(id % 3 as int))) as text")
    pairs = looks.same_look_pairs(docs, "doc_id", "text")
    assert pairs.count() == 3 * 20 * 20


def leaks_by_hand(docs, items):
    out = set()
    for d, text in docs:
        w = leaks.words(text or "")
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, t in items:
            v = leaks.words(t or "")
            if any(tuple(v[k : k + 12]) in runs for k in range(len(v) - 11)):
                out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize(("other", "plain"), [
    ("noёl", "noël"), ("naїve", "naïve"), ("crѐme", "crème"), ("Տeсurе", "Secure"), ("ᎪᏢᏞ", "APL"), ("ꓮꓐꓚ", "ABC"), ("ɑlphɑ", "alpha"), ("fıle", "file"), ("a∶b", "a:b"), ("ΠΡΟΣ", "ПΡΟΣ"), ("hоuѕе", "house"),
])
def test_twins_of_further_scripts_and_accents(other, plain):
    assert uniform(other) == uniform(plain)


@pytest.mark.parametrize("text", ["ещё", "kız ağaç", "ПРОСТО", "ոսկի", "Ἑλλάς", "Straße", "Здравствуйте on мир"])
def test_real_words_stay(text):
    assert uniform(text) == text


def test_leaks_against_brute_force(spark):
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(5, 60)))) for i in range(30)] + [(99, None), (98, ""), (97, None)]
    docs = []
    for d in range(120):
        words = draw.choices(vocabulary, k=draw.randint(0, 80))
        if d % 2:
            own = items[draw.randrange(30)][1].split()
            at = draw.randrange(max(1, len(own) - 11))
            words[10:10] = own[at : at + draw.randint(9, 20)]
        docs.append((d, (" " if d % 3 else "\n> ").join(words)))
    docs += [(500, None), (501, "")]
    a, b = spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(items, "id bigint, text string")
    got = leaks.leaks(a, "id", "text", b, "id", "text")
    exact = rows(got.where("longest_run >= 12").select("doc_id", "item_id").distinct(), "doc_id", "item_id")
    assert exact == leaks_by_hand(docs, items)
    assert leaks.leaks(a.limit(0), "id", "text", b, "id", "text").count() == 0
    assert leaks.leaks(a, "id", "text", b.limit(0), "id", "text").count() == 0


def test_leak_with_substitutions(spark):
    item = " ".join(f"t{k}" for k in range(40))
    words = item.split()
    words[7] = words[19] = words[31] = "other"
    doc = "before " + " ".join(words) + " after"
    got = leaks.leaks(spark.createDataFrame([(1, doc)], "i bigint, t string"), "i", "t", spark.createDataFrame([(2, item)], "i bigint, t string"), "i", "t").collect()
    assert [(r.doc_id, r.item_id, r.longest_run, r.matched, r.spanned) for r in got] == [(1, 2, 11, 37, 40)]


def test_a_full_filter_only_lets_more_through(spark):
    import numpy as np
    import pyarrow as pa

    class Full:
        value = np.full(1 << (leaks.FILTER_BITS - 3), 255, np.uint8)

    text = " ".join(f"w{k}" for k in range(20))
    batch = pa.RecordBatch.from_arrays([pa.array([3, 4, 5]), pa.array([text, "short", text + " x"])], names=["id", "text"])
    (out,) = leaks._hits(Full)(iter([batch]))
    assert [(r["doc_id"], len(r["seeds"])) for r in out.to_pylist()] == [(3, 27), (5, 30)]
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(8)] * 2, "id bigint, text string")
    assert rows(leaks.leaks(items, "id", "text", items, "id", "text"), "doc_id", "item_id") == [(k, k) for k in range(8)]


def test_leaks_in_look_alike_capitals(spark):
    """A passage in capitals spelled with Cyrillic twins, within a Russian text."""
    item = "the cat took her box to a market near the park before we met at home"
    twins = dict(zip("ABCEHKMOPTXY", "АВСЕНКМОРТХУ"))
    said = "".join(twins.get(c, c) for c in item.upper())
    doc = "Это просто заметка о том, что было вчера. " + said + ". Больше ничего не было."
    got = leaks.leaks(spark.createDataFrame([(1, doc), (2, item.title())], "i bigint, t string"), "i", "t", spark.createDataFrame([(7, item)], "i bigint, t string"), "i", "t").collect()
    assert sorted((r.doc_id, r.longest_run) for r in got) == [(1, 16), (2, 16)]


def test_recall_under_substitutions(spark):
    """Every passage of 24 words with one word exchanged is found, and nearly all with two or three."""
    draw = random.Random(9)
    items = [(k, " ".join(f"k{draw.randrange(10**6)}" for _ in range(24))) for k in range(60)]
    for wrong, least in ((1, 1.0), (2, 0.95), (3, 0.8)):
        docs = []
        for k, text in items:
            words = text.split()
            for at in draw.sample(range(24), wrong):
                words[at] = "other"
            docs.append((k, " ".join(words)))
        a, b = (spark.createDataFrame(x, "id bigint, text string") for x in (docs, items))
        got = {(r.doc_id, r.item_id) for r in leaks.leaks(a, "id", "text", b, "id", "text").collect()}
        assert got <= {(k, k) for k in range(60)} and len(got) >= least * 60, (wrong, len(got))


def test_packing(spark):
    draw = random.Random(1)
    sizes = [(k, draw.choice([0, 1, 5, 90, 100, 250, 251])) for k in range(400)] + [(1000, 100), (1001, 100), (1001, 100)]
    out = packing.pack(spark.createDataFrame(sizes, "id bigint, n_tokens bigint"), capacity=100, group_tokens=5000).collect()
    used: dict = {}
    for r in out:
        assert 0 <= r.n_tokens <= 100 and (r.container is None) == (r.n_tokens == 0)
        assert r.pieces == max(1, -(-dict(sizes)[r.id] // 100))
        if r.container is not None:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n for _, n in sizes)
    whole = [r for r in out if r.id == 0 or r.pieces == 1]
    assert all(r.start == 0 for r in whole)
    assert packing.pack(spark.createDataFrame([], "id bigint, n_tokens bigint")).count() == 0


def test_pack_sizes_fills():
    draw = random.Random(2)
    sizes = sorted((draw.randint(1, 400) for _ in range(3000)), reverse=True)
    bins = packing.pack_sizes(sizes, 1000)
    load = [0] * (max(bins) + 1)
    for n, b in zip(sizes, bins):
        load[b] += n
    assert max(load) <= 1000 and sum(load) / (1000 * len(load)) > 0.97


def test_token_counts_are_exact(spark, monkeypatch):
    with open(packing.RANKS, "rb") as f:
        count = packing.TokenCounter(f.read())
    texts = ["", "It's a test, naïve  text\n\n  with   spaces", "слово" * 50, "x" * 3000, "a b " * 700]
    assert [sum(len(count.encode(m[0])) for m in packing.CUTS.finditer(t)) for t in texts] == [len(count.encode(t)) for t in texts]
    df = spark.createDataFrame([(1, None), (2, ""), (3, texts[1]), (None, "gone")], "doc_id bigint, text string")
    assert rows(packing.token_counts(df, "doc_id", "text"), "id", "n_tokens") == [(1, 0), (2, 0), (3, len(count.encode(texts[1])))]


def test_term_counts_against_plain_counting(spark):
    draw = random.Random(3)
    words = [f"{a}{b}" for a in ("pre", "prefix", "q", "слово") for b in range(900)] + ["p", "prefix"]
    data = [(k, [draw.choice(words) for _ in range(draw.randint(0, 30))] + [" Hot ", None, "hot", " "]) for k in range(500)] + [(900, None), (901, [])]
    want: dict = {}
    for _, ts in data:
        clean = [t.strip().lower() for t in ts or () if t and t.strip()]
        for t in set(clean):
            o, r = want.get(t, (0, 0))
            want[t] = (o + clean.count(t), r + 1)
    df = spark.createDataFrame(data, "id bigint, term array<string>")
    got = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df.repartition(5), "term").collect()}
    assert got == want
    marks = {r.term: r.mark for r in terms.term_marks(df, "term").collect()}
    assert marks["hot"] == "common" and {m for t, m in marks.items() if want[t][1] == 1} == {"rare"}
    assert terms.term_marks(df.limit(0), "term").count() == 0


def test_burst_trie_keeps_inner_terms():
    trie = terms.BurstTrie(limit=2)
    for t in ("a", "ab", "abc", "abcd", "", "b", "ab"):
        trie.add(t, 1, 1)
    assert {p + s: c for p, held in trie.subtrees() for s, c in held.items()} == {"a": [1, 1], "ab": [2, 2], "abc": [1, 1], "abcd": [1, 1], "": [1, 1], "b": [1, 1]}
