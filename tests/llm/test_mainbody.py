import random

from sparrowdex.llm import mainbody
from sparrowdex.llm.mainbody import Furniture, boilerplate_lines, evidence, learn_furniture, main_bodies, main_body, outside_lines, word_counts

PAGE = """Docs | Blog | **Forum** | Login

Docs > Blog > How the cache warms

# How the cache warms

Updated 2025-01-02 · 4 min read

The cookie set by `get_tree` expires after 52 days, which the cursor ignores. It holds the last known state.

- [Why the tree needs a root](/leaf/read_tree): It keeps the outer node.
- [Edge and node](/edge/walk)

---
Join 2400 readers and get the weekly digest by mail.
[OK](#)

| path | n |
| --- | --- |
| `a` | 1 |

```
Docs | Blog

Accept all
```

**Most read**
[Moving from a to b](/moving-from-a-to-b) (42)
[Edge and leaf](/edge-and-leaf) (7)

To subscribe to the tree, pass a edge to `quota`.

← Older page
Newer page →

We use cookies and similar storage to improve the service. Choose what you allow below.

Accept all
Reject

Warmsite © 2025. Imprint. All rights reserved."""


def english(n=60, seed=2):
    """Pages with notices, buttons and boxes above the title or below the text."""
    rng = random.Random(seed)
    notice = ["We use cookies and similar storage to improve the service.", "Choose what you allow below.", "You may decline at any time."]
    nouns = "tree cache node edge leaf token cursor ledger batch shard".split()
    out = []
    for i in range(n):
        text = [f"The {rng.choice(nouns)} of `x_{i}` holds the last known {rng.choice(nouns)} and then leaves the {rng.choice(nouns)} alone." for _ in range(5)]
        head = [" ".join(rng.sample(notice, 2)), "\n".join(rng.sample(["Accept all", "Reject", "Manage choices"], 2))]
        box = "**Most read**\n[Edge and leaf](/edge-and-leaf) (7)"
        title = f"# How the {rng.choice(nouns)} works {i}"
        out.append(("\n\n".join(["Docs | Blog | Forum", *head, title, *text, box] if i % 2 else ["Docs | Blog | Forum", title, *text, *head, box]), title[2:], f"https://site{i}.example/x"))
    return out


def learned(pages, rounds=2):
    known = Furniture()
    for _ in range(rounds):
        known = evidence({w: tuple(c) for w, c in word_counts(pages, known).items()})
    return known


def test_page():
    gone = outside_lines(PAGE, "How the cache warms - Warmsite", "https://www.warmsite.example/x", learned(english()))
    lines = PAGE.split("\n")
    out = [lines[i - 1] for i in gone]
    kept = [x for i, x in enumerate(lines, 1) if i not in gone and x.strip()]
    assert not any("`" in x or x.startswith(("|", "- [")) for x in out)
    for part in ("Docs | Blog | **Forum**", "Docs > Blog", "Updated 2025", "---", "Join 2400", "[OK](#)", "**Most read**", "[Moving", "← Older", "Newer page", "We use cookies", "Reject", "Warmsite ©"):
        assert any(x.startswith(part) for x in out), part
    assert kept[0] == "# How the cache warms" and "Accept all" in kept  # inside the fence
    assert all(lines[i - 1].strip() for i in gone)


def test_density_decides(monkeypatch):
    """Without link adjustment, and without the threshold, other lines come out."""
    known = learned(english())
    whole = outside_lines(PAGE, "How the cache warms", None, known)
    monkeypatch.setattr(mainbody, "_density", lambda chars, tags, *rest: chars / max(tags, 1))
    assert outside_lines(PAGE, "How the cache warms", None, known) != whole
    monkeypatch.undo()
    above = "Offers of the week.\n\nBuy two.\n\n# How the cache warms\n\n" + "The cache holds the last known state of each block it has met. " * 12 + "\n\n## Edge\n\n" + "It leaves the index alone and goes on with the next one of them. " * 12
    assert outside_lines(above, "How the cache warms") == [1, 3]  # unknown words: the threshold of the path decides


def test_fifth_language():
    """Nothing here knows Italian; notices above the titles of some pages teach it for the others."""
    rng = random.Random(5)
    nouns = "albero memoria nodo foglia indice registro blocco cursore".split()
    notice = ["Usiamo i cookie per ricordare le vostre preferenze.", "Potete rifiutare in ogni momento.", "Scegliete che cosa consentire."]
    buttons = ["Accetta tutto", "Rifiuta", "Gestisci le scelte"]

    def page(i, above):
        text = [f"Il {rng.choice(nouns)} legge ogni {rng.choice(nouns)} che incontra e lascia in pace il {rng.choice(nouns)}." for _ in range(5)]
        note = [" ".join(rng.sample(notice, 2)), "\n".join(rng.sample(buttons, 2))]
        top, title = ["[Vai al testo](#main)", "Guide | Blog | Stato"], f"# Come funziona il {rng.choice(nouns)} {i}"
        letter = "---\nRicevete la nostra lettera ogni mese.\n[OK](#)"
        return ("\n\n".join([*top, *note, title, *text, letter] if above else [*top, title, *text[:3], letter, *text[3:], *note]), title[2:], f"https://s{i}.example")

    known = learned([page(i, i % 3 > 0) for i in range(60)])
    for i in range(100, 110):
        text, title, url = page(i, False)
        gone, lines = set(outside_lines(text, title, url, known)), text.split("\n")
        for k, x in enumerate(lines, 1):
            if x.strip():
                assert (k in gone) == (not x.startswith(("Il ", "# "))), x


def test_edges():
    assert outside_lines(None) == [] and outside_lines("") == [] and outside_lines(" \n\n") == []
    assert outside_lines("Just one paragraph of text that is the article.") == []
    assert outside_lines("```\nunclosed fence\n\nText after it, which is long enough.") == []
    assert main_body(None) is None and main_body("") == ""
    assert outside_lines("Text.\r\n\r\n[Mail](#) [RSS](#)\r\n", None, None) == [3]
    assert outside_lines(("A long line of text without an end " * 20 + "\n\n") * 3000) == []


def test_frames(spark):
    rows = [(1, PAGE, None, None), (2, None, "t", "u"), (None, "x", "t", "u"), (3, "", None, None), (3, "[Top](#)", None, None)]
    df = spark.createDataFrame(rows, "page_id long, content_markdown string, title string, url string").selectExpr("*", "1 AS id", "2 AS line_no")
    got = boilerplate_lines(df, "page_id", "content_markdown", "title", "url").collect()
    assert {r["id"] for r in got} == {1, 3}
    assert {r["id"]: r["body"] for r in main_bodies(df, "page_id", "content_markdown", "title", "url").collect() if r["id"] == 2} == {2: None}
    assert boilerplate_lines(df.limit(0), "page_id", "content_markdown", "title", "url").count() == 0


def test_learned_on_a_sample(spark):
    rows = [(i, *x) for i, x in enumerate(english(80))]
    df = spark.createDataFrame(rows, "page_id long, content_markdown string, title string, url string")
    names = ("page_id", "content_markdown", "title", "url")
    whole, part = learn_furniture(df, *names), learn_furniture(df, *names, sample_pages=40)
    assert whole.ratio == learned(english(80)).ratio and part.ratio and part.ratio != whole.ratio
    lines = {i: x[0].split("\n") for i, x in enumerate(english(80))}
    gone = {(r["id"], r["line_no"]) for r in boilerplate_lines(df, *names, known=part).collect()}
    for i, own in lines.items():
        for k, x in enumerate(own, 1):
            if x.strip():
                assert ((i, k) in gone) == (not x.startswith(("The ", "# "))), x


def test_learned_from_all_pages(spark):
    """One page in a thousand of 5,000 has the words of a box that only counting all of them finds."""
    texts = [x for x in english(50) for _ in range(100)]
    note = "Zirbel quorn vlack"
    rows = [(i, *x) if i % 1000 else (i, note + ".\n\n" + x[0], *x[1:]) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, content_markdown string, title string, url string")
    known = learn_furniture(df, "page_id", "content_markdown", "title", "url")
    all_ = learned([x[1:] for x in rows])
    assert known.ratio == all_.ratio and known.prior == all_.prior and "zirbel" in known.ratio
    gone = {(r["id"], r["line_no"]) for r in boilerplate_lines(df.filter("page_id < 1001"), "page_id", "content_markdown", "title", "url", known=known).collect()}
    assert {(i, k) for i in (0, 1, 500, 1000) for k in outside_lines(*rows[i][1:], all_)} == {(i, k) for i, k in gone if i in (0, 1, 500, 1000)}
