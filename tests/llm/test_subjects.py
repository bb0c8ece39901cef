import random

import numpy as np

from sparrowdex.llm.subjects import FIRST, Chain, fit_chain, subject_areas, term_stream

WORDS = {
    "law": "verdict plaintiff statute bailiff clause tort lease".split(),
    "music": "violin melody sonata chord cello tempo reverb".split(),
    "travel": "airport passport luggage ferry cabin visa tram".split(),
}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    names = list(WORDS)
    filler = "the cache loads every block it meets and then leaves the index alone".split()
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(names, 2 if i % 6 == 0 else 1)
        truth[i] = set(own)
        lines = []
        for s in own:
            lines += [f"A {rng.choice(WORDS[s])} can have up to {rng.randint(1, 99)} entries of type {rng.choice(WORDS[s])}." for _ in range(5)]
        if i % 5 == 0:
            lines.append(f"The old text called it {rng.choice(WORDS[rng.choice(names)])}.")
        lines += [" ".join(rng.sample(filler, 8)) + "." for _ in range(4)]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    return docs, truth


def run(spark, docs, labels, names=tuple(WORDS), **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS mask", "2 AS stream", "3 AS term")
    s = spark.createDataFrame(labels, "doc_id long, subject string").selectExpr("*", "'x' AS annotator")
    t = spark.createDataFrame([(n,) for n in names], "subject string")
    out = {}
    for r in subject_areas(d, s, t, **how).collect():
        out.setdefault(r["doc_id"], set()).add(r["subject"])
    return out


def test_held_out(spark):
    docs, truth = corpus()
    labels = [(i, s.upper() + " ") for i in range(0, 60) for s in truth[i]] + [(0, "unknown"), (None, "law"), (9999, "law"), (3, None), (7, "music" if "music" not in truth[7] else "law")]
    got = run(spark, docs, labels)
    held = [i for i in truth if i >= 60]
    assert np.mean([got[i] == truth[i] for i in held]) > 0.9
    assert set(got) == set(truth) and all(1 <= len(s) <= 2 for s in got.values())


def test_shares_of_a_third(spark):
    """A third of all rows copies of one text, and more than a third of the others about one subject, with the production parameters."""
    rng = random.Random(4)
    names = ["law", "music", "travel", "pottery", "falconry"]
    words = WORDS | {"pottery": "kiln glaze wheel slip bisque clay ash".split(), "falconry": "hood jess lure perch talon mews glove".split()}
    filler = "the cache loads every block it meets and then leaves the index alone".split()

    def text(own):
        return "\n".join(" ".join(rng.sample(words[own], 3)) + " " + " ".join(rng.sample(filler, 6)) + "." for _ in range(6))

    truth = {i: names[0] if i % 5 < 2 else names[i % 5] if i % 10 != 9 else names[1] for i in range(240)}
    docs = [(i, text(s), "en", "s") for i, s in truth.items()]
    copied = "\n".join(" ".join(words["music"][k:] + words["music"][:k] + filler) + "." for k in range(1, 6))
    docs += [(1000 + i, copied, "en", "s") for i in range(120)]
    got = run(spark, docs, [(i, truth[i]) for i in range(0, 240, 3)], names)
    assert all(got[i] == {"music"} for i in range(1000, 1120))
    assert np.mean([got[i] == {s} for i, s in truth.items() if i % 3]) > 0.9


def links(rng, n):
    """Texts of two subjects of which the second needs little evidence for subject 1 and much for the others, and is left out by source 1."""
    k, x = 3, np.zeros((n, 3, 12))
    y = np.zeros((n, k))
    for r in range(n):
        a, b = rng.choice(k, 2, replace=False)
        share, source = rng.random(), rng.integers(0, 2)
        x[r, a, [2, FIRST]] = 1
        x[r, b, [2, 3]] = share
        x[r, :, 10 + source] = 0.3
        y[r, a] = 1
        y[r, b] = share > (0.2 if b == 1 else 0.7) and not (source and b == 2)
    return x, y, x[:, :, 2] * 5


def test_fitted_links_decide():
    rng = np.random.default_rng(3)
    x, y, count = links(rng, 400)
    held, truth, _ = links(rng, 400)
    fitted = fit_chain(x, y, count)
    by_hand = np.zeros(12)
    by_hand[[3, FIRST]] = 12.0, 8.0
    hand = Chain([0, 1, 2], np.tile(by_hand, (3, 1)), np.zeros((3, 3)), np.full(3, -5.0), np.ones(3), np.zeros(3))
    right = [np.mean((c.decode(held) == truth).all(axis=1)) for c in (fitted, hand)]
    assert right[0] > 0.93 and right[0] > right[1] + 0.1
    p = np.stack([fitted.link(fitted.scores(held), j, truth) for j in range(3)], axis=1)  # calibrated, given the labels of earlier links
    assert np.abs(p.mean(axis=0) - truth.mean(axis=0)).max() < 0.1


def test_without_labels(spark):
    docs, _ = corpus(20)
    assert run(spark, docs, []) == {} and run(spark, docs, [(0, "unknown"), (999, "law")]) == {}


def test_one_subject_at_most(spark):
    docs, truth = corpus(60)
    got = run(spark, docs, [(i, s) for i in range(40) for s in truth[i]], most=1)
    assert all(len(s) == 1 for s in got.values()) and np.mean([got[i] <= truth[i] for i in truth]) > 0.9


def test_edges(spark):
    docs, truth = corpus(60)
    docs += [(500, None, None, None), (501, "", "EN ", ""), (None, "violin", "en", "s"), (502, "violin melody " * 50_000, "en", "s1"), (500, "violin", "en", None)]
    got = run(spark, docs, [(i, s) for i in range(30) for s in truth[i]])
    assert {500, 501, 502} <= set(got) and None not in got and "music" in got[502]
    assert run(spark, docs[:0], [(1, "law")]) == {}
    assert run(spark, docs[:3], [(0, "law")], names=()) == {}
    assert set(run(spark, docs[:3], [(0, "law")])) == {0, 1, 2}


def test_terms():
    assert term_stream("A `code_x` Word fooBar my_name; next-door\nÉté 12") == ["a", "word", "", "next-door", "", "été"]
    assert term_stream(None) == []


def test_beam_equals_enumeration():
    rng = np.random.default_rng(0)
    k, x = 4, rng.normal(size=(20, 4, 10))
    chain = Chain([2, 0, 3, 1], rng.normal(size=(k, 10)), rng.normal(size=(k, k)), rng.normal(size=k) * 0.3, np.full(k, 0.8), rng.normal(size=k) * 0.1)
    for beam in (64, 1):
        best = chain.decode(x, beam=beam)
        s = chain.scores(x)
        for r in range(len(x)):
            scores = {}
            for combo in [(a,) for a in range(k)] + [(a, b) for a in range(k) for b in range(a)] * (beam > 1):
                before, total = np.zeros((1, k)), 0.0
                for j in chain.order:
                    p = chain.link(s[r : r + 1], j, before)[0]
                    total += np.log(p if j in combo else 1 - p)
                    before[0, j] = j in combo
                scores[combo] = total
            top = max(scores, key=scores.get)
            assert set(np.flatnonzero(best[r])) == set(top) or beam == 1 and best[r].sum() > 0
