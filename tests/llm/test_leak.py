import random

from sparrowdex.llm.hashing import TokenHasher
from sparrowdex.llm.leak import ItemIndex, _tile, folded_words, leaks


def test_words():
    assert folded_words("The ﬁle­name, Stra​ße_2: ＡＢ ć") == ["the", "filename", "strasse", "2", "ab", "ć"]
    assert folded_words(None) == [] and folded_words("") == [] and folded_words("—") == []


def runs_of(text, passage, n):
    have = {tuple(text[i : i + n]) for i in range(len(text) - n + 1)}
    return any(tuple(passage[i : i + n]) in have for i in range(len(passage) - n + 1))


def test_longest_run_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 40)))) for i in range(25)]
    docs = []
    for d in range(120):
        own = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if d % 2:
            part = rng.choice(items)[1].split()
            cut = rng.randint(0, len(part))
            own[rng.randint(0, len(own)) : 0] = part[cut : cut + rng.randint(8, 16)]
        docs.append((d, " ".join(own).replace("w1 ", "W1, ")))
    want = {(d, i) for d, t in docs for i, p in items if runs_of(folded_words(t), folded_words(p), 12)}
    df = spark.createDataFrame(docs + [(500, None), (None, items[0][1]), (501, "")], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS covered")
    it = spark.createDataFrame(items + [(800, None), (None, "x"), (801, "")], "item_id long, passage string").selectExpr("*", "'t' AS text", "7 AS doc_id")
    for block in (200_000, 50):
        got = leaks(df, "doc_id", "text", it, "item_id", "passage", min_match=12, longest=12, coverage=None, block_words=block)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert want
    assert leaks(df, "doc_id", "text", it.limit(0), "item_id", "passage").count() == 0
    assert leaks(df.limit(0), "doc_id", "text", it, "item_id", "passage").count() == 0


def test_reordered(spark):
    p = [f"a{i}" for i in range(30)]
    shuffled = p[20:30] + ["x"] + p[10:20] + ["y"] + p[0:10]
    docs = spark.createDataFrame([(1, " ".join(shuffled)), (2, " ".join(p[:6])), (3, " ".join(p))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(p))], "item_id long, passage string")
    got = {r["doc_id"]: (r["longest"], r["tiles"], round(r["covered"], 3)) for r in leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == {1: (10, 3, 1.0), 3: (30, 1, 1.0)}


def test_tiles_do_not_overlap():
    assert sorted(_tile([(6, 0, 0), (5, 4, 10)], 20, 20, 3)) == [(3, 6, 12), (6, 0, 0)]
    text = "a b c d e a b c d e".split()
    index = ItemIndex([(1, "a b c d e".split())], 3)
    assert index.tiles(text) == [(1, [(5, 0, 0)])]
    assert index.tiles([]) == [] and ItemIndex([], 3).tiles(text) == []
    assert index.tiles(["z"] * 100_000 + text)[0][1][0][0] == 5


def test_hasher_forgets():
    h = TokenHasher(bound=4)
    first = h(list("abcdef")).tolist()
    assert h(list("ghijkl")).tolist() != first and h(list("abcdef")).tolist() == first
