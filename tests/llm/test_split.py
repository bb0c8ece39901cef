from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowdex.llm.split import PARAGRAPH, SENTENCE, CutIndex, pieces, split_items


def sound(text, limit, overlap):
    raw, got = text.encode("utf-8", "surrogatepass"), pieces(text, limit, overlap)
    if not raw:
        assert got == []
        return got
    assert got[0].first == 0 and got[-1].last == len(raw)
    for p in got:
        piece = raw[p.first : p.last].decode("utf-8", "surrogatepass")
        assert piece and (p.last - p.first <= limit or len(piece) == 1)
    for a, b in zip(got, got[1:]):
        assert a.first < b.first <= a.last < b.last
    return got


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n\r\té€😀́#-", max_size=300), st.integers(1, 60), st.integers(0, 40))
def test_pieces_cover(text, limit, overlap):
    sound(text, limit, overlap)


def test_natural_places():
    text = "First sentence. Second one here.\n\nA new paragraph follows, with words. And more of them."
    got = sound(text, 60, 0)
    assert text.encode()[: got[0].last].decode().endswith("here.\n\n") and got[0].strength == PARAGRAPH
    assert sound("One two three. Four five six seven", 20, 0)[0].strength == SENTENCE


def test_ties_go_right():
    assert pieces("a b c d e f g h", 8, 0)[0].last == 8


def test_no_places():
    got = sound("x" * 1000, 64, 16)
    assert all(p.last - p.first <= 64 for p in got) and all(a.last - b.first == 16 for a, b in zip(got, got[1:]))
    assert len(sound("é" * 500, 9, 0)) == 125
    assert sound("😀😀", 1, 0)[0].last == 4


def test_crlf_is_not_parted():
    text = "ab\r\n" * 40
    for p in sound(text, 7, 0)[:-1]:
        assert text.encode()[p.last - 1 : p.last + 1] != b"\r\n"


def test_range_maximum():
    index = CutIndex(b"a b. c, d\n\ne f. g")
    for low in range(18):
        for high in range(low, 18):
            inside = [(s, p) for p, s in zip(index.at.tolist(), index.strength.tolist()) if low <= p <= high]
            assert index.strongest(low, high) == ((max(inside)[1], max(inside)[0]) if inside else None)


def test_long_text():
    sound("word and more. " * 200_000, 4000, 300)


def test_items(spark):
    items = spark.createDataFrame([("d", 1, "s", "a b " * 30), ("d", 2, "s", "short"), ("d", 3, "t", "x" * 500), ("d", None, "s", "y" * 500), ("d", 4, None, "z" * 500), ("d", 5, "s", None), ("d", 1, "s", "c d " * 30)], "item_kind string, item_id long, scope string, body string")
    items = items.selectExpr("*", "1 AS most", "2 AS r", "3 AS max_bytes")
    limits = spark.createDataFrame([("s", 50, 10), ("s", 60, None), ("t", None, 5), ("t", 0, 1), (None, 3, 1)], "scope string, max_bytes int, overlap_bytes int")
    got = split_items(items.select("item_kind", "item_id", "scope", "body", "most", "r"), limits).collect()
    assert {r["item_id"] for r in got} == {1} and len([r for r in got if r["piece_no"] == 1]) == 2
    assert all(len(r["piece"].encode()) <= 50 == 50 for r in got)
    assert split_items(items.select("item_kind", "item_id", "scope", "body").limit(0), limits).count() == 0
    assert split_items(items.select("item_kind", "item_id", "scope", "body"), limits.limit(0)).count() == 0


def test_wide_overlap():
    """An overlap above half of the limit is kept, up to three quarters of it."""
    text = " ".join(f"word{i}" for i in range(400))
    raw = text.encode()
    for overlap, kept in ((60, 60), (75, 75), (500, 75)):
        got = pieces(text, 100, overlap)
        assert got[0].first == 0 and got[-1].last == len(raw) and all(p.last - p.first <= 100 for p in got)
        shared = [a.last - b.first for a, b in zip(got, got[1:])]
        assert all(b.first > a.first for a, b in zip(got, got[1:])) and min(shared) >= kept * 0.75 - 8
