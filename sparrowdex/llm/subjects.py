"""Subject areas of documents: classifier chains over term, source and structure features.

1. Each text is read once, as a stream of hashed terms; vocabulary and term
   statistics come from all documents.
2. Evidence of terms for subjects starts from the hand labels alone.  Rounds over
   all documents extend it: a term counts for a subject as far as the subjects of
   its documents differ from what their language alone would let expect, and each
   document counts as far as the evidence so far is clear about it.
3. A chain of logistic links, one a subject in order of frequency, is fitted on
   labelled documents.  Each link has weights of its own, shrunk towards weights
   in common: evidence, its spread over the text and its share against the
   strongest subject, source and structure of the text, the labels of earlier
   links.  The evidence of a labelled document is taken without its own share in
   the statistics, so that links see what they will see on other documents.
4. Probabilities are calibrated on labels that the links were not fitted on, and a
   beam search decodes the likeliest combination of labels.

The model has a bounded size (max_terms terms times subjects); each round reads
a compact table of term ids and merges one row a term and task, with a number of
tasks that does not grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.hashing import TokenHasher
from sparrowdex.runtime import dropped, spread, written

_hasher = TokenHasher()
_CODE = re.compile(r"`[^`\n]*`|\b\w*(?:_\w+|[^\W\d_A-Z][A-Z])\w*")
_TERM = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[.!?;\n]")


def term_stream(text: str | None) -> list[str]:
    """Lower-case words without code and identifiers; "" where a sentence or line ends."""
    return ["" if t in ".!?;\n" else t for t in _TERM.findall(_CODE.sub(" ", text or "").lower())]


def _term_ids(terms: list[str]) -> np.ndarray:
    """64-bit hashes of terms; 0 for "", where a sentence ends; terms of one letter fall away."""
    h = _hasher(terms) if terms else np.empty(0, np.uint64)
    whole = np.fromiter((len(t) for t in terms), dtype=np.int64, count=len(terms))
    return np.where(whole == 0, np.uint64(0), np.maximum(h, np.uint64(1)))[whole != 1]


@dataclass
class Evidence:
    """Weights of terms for subjects, the subject that owns a term (-1 for none), and the statistics they come from."""

    weight: np.ndarray
    owner: np.ndarray
    counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    least: float


def _unpack(pdf: pd.DataFrame):
    """Flat ids, their row and their sentence (over all rows), of a batch of term streams."""
    arrays = [np.frombuffer(x, np.int32) for x in pdf["stream"]]
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    row = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    sentence = np.cumsum(flat < 0)
    keep = flat >= 0
    return flat[keep].astype(np.int64), row[keep], sentence[keep]


def _distinct(flat: np.ndarray, row: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    u = np.unique(row * v + flat)
    return u % v, u // v


def _sum_by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(row, weights=values[:, k], minlength=n)
    return out


def _marks(mask: np.ndarray, k: int) -> np.ndarray:
    """Given subjects of each row as weights that sum to 1, all zero without any."""
    m = mask.astype(np.int64)
    y = np.stack([(m >> j) & 1 for j in range(k)], axis=1).astype(np.float64) if len(m) else np.empty((0, k))
    return y / np.maximum(y.sum(1, keepdims=True), 1)


def weigh(c: np.ndarray, n: np.ndarray, priors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and owners of terms, from their documents by subject (terms, subjects) and by language (terms, languages).

    A term is topical where its subjects differ from those of its documents'
    languages by a likelihood ratio of at least `least` and by a fifth of the most that is possible a document.
    """
    k, total = c.shape[1], n.sum(axis=1)
    e = (n @ priors + 0.1) / (total + 0.1 * k)[:, None]
    p = (c + 2 * e) / (total + 2)[:, None]
    gain = (p * np.log(p / e)).sum(axis=1)
    topical = (gain > 0.2 * np.log(max(k, 2))) & (2 * total * gain > least)
    weight = np.where(topical[:, None], np.log(np.maximum(p, 0.01) / np.maximum(e, 0.01)), 0.0)
    return weight, np.where(topical & (p.max(axis=1) > 0.5), p.argmax(axis=1), -1)


def _evidence(c: np.ndarray, n: np.ndarray, whole: np.ndarray, least: float) -> Evidence:
    """Evidence from the statistics; whole: (languages, subjects), the documents of each."""
    total = whole.sum(axis=0)
    flat = (total + 1) / (total.sum() + len(total))
    priors = (whole + 4 * flat) / (whole.sum(axis=1, keepdims=True) + 4)
    return Evidence(*weigh(c, n, priors, least), (c, n, priors), least)


def posterior(ev: Evidence | None, pdf: pd.DataFrame, k: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subject weights of each text of a batch, how far it counts, and its distinct terms and their rows.

    Without evidence only labelled texts count.  With it a text counts the more,
    the more terms of its strongest subject it has and the clearer that subject is.
    """
    n = len(pdf)
    flat, row, _ = _unpack(pdf)
    term, at = _distinct(flat, row, v)
    given = _marks(pdf["mask"].fillna(0).to_numpy(), k)
    has = given.sum(1) > 0
    if ev is None:
        return given, has.astype(float), term, at
    score = _sum_by_row(ev.weight[term], at, n)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    z = e / e.sum(axis=1, keepdims=True)
    own = ev.owner[term]
    hits = np.bincount(at[own >= 0] * k + own[own >= 0], minlength=n * k).reshape(n, k).max(axis=1) if n else np.zeros(0)
    use = (1 - np.exp(-hits / 2)) * np.clip((z.max(axis=1) - 0.3) / 0.7, 0, 1)
    z[has] = 0.3 * given[has] + 0.7 * z[has]
    use[has] = 1.0
    return z, use, term, at


def statistics(ev: Evidence | None, pdf: pd.DataFrame, k: int, v: int, langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of each term by subject and by language, and of each language by subject."""
    z, use, term, at = posterior(ev, pdf, k, v)
    w, lang = use * pdf["share"].to_numpy(), pdf["lang"].to_numpy()
    c = np.stack([np.bincount(term, weights=z[at, j] * w[at], minlength=v) for j in range(k)], axis=1)
    n = np.bincount(term * langs + lang[at], weights=w[at], minlength=v * langs).reshape(v, langs)
    return c, n, np.stack([np.bincount(lang, weights=z[:, j] * w, minlength=langs) for j in range(k)], axis=1)


def learn_evidence(rows: DataFrame, ev: Evidence, rounds: int, least: float, tasks: int) -> tuple[Evidence, Evidence]:
    """The evidence after rounds of statistics over all documents, and the one before the last round.

    Every task gives one row a term it saw, with its documents by subject and
    language, and one a language; `tasks` bounds their number, whatever the data.
    """
    spark, before = rows.sparkSession, ev
    (v, k), langs = ev.weight.shape, ev.counts[2].shape[0]
    names = [f"c{j}" for j in range(k)] + [f"n{g}" for g in range(langs)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(ev)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            all_c, all_n, all_whole = np.zeros((v, k)), np.zeros((v, langs)), np.zeros((langs, k))
            for pdf in batches:
                if len(pdf):
                    c, n, whole = statistics(shared.value, pdf, k, v, langs)
                    all_c += c
                    all_n += n
                    all_whole += whole
            live = np.flatnonzero(all_n.any(axis=1))
            body = np.concatenate([all_c[live], all_n[live]], axis=1)
            head = np.concatenate([all_whole, np.zeros((langs, langs))], axis=1)
            out = pd.DataFrame(np.concatenate([head, body]), columns=names)
            out.insert(0, "term", np.concatenate([-1 - np.arange(langs), live]))
            yield out

        stats = rows.coalesce(tasks).mapInPandas(count, "term long, " + ", ".join(f"{x} double" for x in names))
        stats = stats.groupBy("term").agg(*[F.sum(x).alias(x) for x in names]).toPandas()  # at most max_terms and langs rows
        shared.unpersist()
        term, got = stats["term"].to_numpy(), stats[names].to_numpy()
        whole, full = np.zeros((langs, k)), np.zeros((v, k + langs))
        whole[-1 - term[term < 0]] = got[term < 0][:, :k]
        full[term[term >= 0]] = got[term >= 0]
        before, ev = ev, _evidence(full[:, :k], full[:, k:], whole, least)
    return ev, before


#: Features of a subject in a text, and of the text itself; after them the sources and the labels of earlier links.
PER, FIRST, TEXT = 9, 7, 4


def features(ev: Evidence, pdf: pd.DataFrame, sources: dict[str, int], before: Evidence | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(texts, subjects, features) for the links without what earlier links decide, and the mentions of each subject.

    With `before`, the evidence of the round before, the share that a text has
    itself in the statistics of ev is taken out for that text.
    """
    (v, k), n = ev.weight.shape, len(pdf)
    flat, row, sentence = _unpack(pdf)
    if before is None:
        term, at = _distinct(flat, row, v)
        weight, own = ev.weight[term], ev.owner[term]
    else:
        z, use, term, at = posterior(before if before is not ev else None, pdf, k, v)
        w, lang = use * pdf["share"].to_numpy(), pdf["lang"].to_numpy()
        c, by_lang, priors = ev.counts
        c, by_lang = c[term] - z[at] * w[at, None], by_lang[term].copy()
        by_lang[np.arange(len(at)), lang[at]] -= w[at]
        weight, own = weigh(np.maximum(c, 0), np.maximum(by_lang, 0), priors, ev.least)
    score = _sum_by_row(weight, at, n)
    mark = own[np.searchsorted(at * v + term, row * v + flat)] if len(flat) else np.empty(0, int)
    ok = mark >= 0
    kinds = np.bincount(at[own >= 0] * k + own[own >= 0], minlength=n * k).reshape(n, k)
    row, sentence, mark = row[ok], sentence[ok], mark[ok]
    count = np.bincount(row * k + mark, minlength=n * k).reshape(n, k).astype(float)
    said = np.unique(sentence * k + mark, return_index=True)[1]
    said = np.bincount(row[said] * k + mark[said], minlength=n * k).reshape(n, k)
    total, top = count.sum(axis=1, keepdims=True), count.max(axis=1, keepdims=True)
    ratio = count / np.maximum(top, 1)
    first = np.zeros((n, k))
    first[np.arange(n), (count + 1e-3 * score).argmax(axis=1)] = 1
    first *= top > 0
    e = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -60, 0))
    text = np.stack([np.log1p(total[:, 0]), np.log1p(pdf["chars"].to_numpy()) / 5, pdf["code"].to_numpy(), pdf["marked"].to_numpy()], axis=1) * 0.3
    source = np.zeros((n, len(sources) + 1))
    source[np.arange(n), [sources.get(s, len(sources)) for s in pdf["source"]]] = 0.3
    per = [np.log1p(count), count / np.maximum(total, 1), ratio, ratio * (1 - first), np.log1p(kinds), np.log1p(said), np.minimum(said, 6) / 3 * (1 - first), first, e / e.sum(axis=1, keepdims=True)]
    both = np.concatenate([text, source], axis=1)
    return np.concatenate([np.stack(per, axis=2), np.repeat(both[:, None, :], k, axis=1)], axis=2), count


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, around: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Newton steps for a logistic regression whose weights are drawn towards `around` (else 0)."""
    around = np.zeros(x.shape[1]) if around is None else around
    w = around.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - around)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class Chain:
    """Links in order of frequency: own weights of each, of its features, of every earlier label, and a bias; calibration."""

    order: list[int]
    weights: np.ndarray  # (subjects, features)
    past: np.ndarray  # (subjects, subjects): weight of an earlier label for a link
    bias: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Logits of all links (texts, subjects), without earlier labels and calibration."""
        return np.einsum("nkf,kf->nk", x, self.weights) + self.bias

    def link(self, s: np.ndarray, subject: int, labels: np.ndarray) -> np.ndarray:
        """Calibrated probability of a subject, given the scores and the labels of earlier links (texts, subjects)."""
        u = (s[:, subject] + labels @ self.past[subject]) * self.scale[subject] + self.shift[subject]
        return np.clip(1 / (1 + np.exp(-np.clip(u, -30, 30))), 1e-9, 1 - 1e-9)

    def decode(self, x: np.ndarray, beam: int = 16, most: int = 2) -> np.ndarray:
        """Labels (texts, subjects) of the likeliest combination of one to `most` subjects, by beam search."""
        n, k = x.shape[0], x.shape[1]
        s = self.scores(x)
        labels, score = np.zeros((1, n, k)), np.zeros((1, n))
        alone = np.zeros((n, k))  # the likeliest single label, which the beam may lose
        total = np.zeros((n, k))
        for at, subject in enumerate(self.order):
            one = np.zeros((n, k))
            p0 = self.link(s, subject, one)
            total += np.log(1 - p0)[:, None]
            alone[:, subject] += np.log(p0) - np.log(1 - p0)
            for before in self.order[:at]:
                one[:, before] = 1
                alone[:, before] += np.log(1 - self.link(s, subject, one)) - np.log(1 - p0)
                one[:, before] = 0
            p = np.stack([self.link(s, subject, lab) for lab in labels])
            put = labels.copy()
            put[:, :, subject] = 1
            both = np.concatenate([labels, put])
            value = np.concatenate([score + np.log(1 - p), np.where(put.sum(axis=2) <= most, score + np.log(p), -np.inf)])
            keep = np.argsort(-value, axis=0, kind="stable")[:beam]
            labels, score = np.take_along_axis(both, keep[:, :, None], axis=0), np.take_along_axis(value, keep, axis=0)
        score = np.where(labels.sum(axis=2) > 0, score, -np.inf)
        best = score.argmax(axis=0)
        out = labels[best, np.arange(n)]
        alone += total
        better = alone.max(axis=1) > score.max(axis=0) if n else np.zeros(0, bool)
        out[better] = np.eye(k)[alone[better].argmax(axis=1)]
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 1.0, own_ridge: float = 3.0, folds: int = 5) -> Chain:
    """Fit and calibrate the links on labelled texts; labels that the text speaks against altogether are left out as mistakes."""
    n, k, f = x.shape
    order = [int(j) for j in np.argsort(-y.sum(axis=0), kind="stable")]
    top = count.max(axis=1) if n else np.zeros(0)
    sound = ((y * count).sum(axis=1) >= 0.3 * top) | (top < 3)
    x, y = x[sound], y[sound]
    place = np.empty(k, dtype=int)
    place[order] = np.arange(k)
    earlier = place[None, :] < place[:, None]

    def design(rows: np.ndarray, j: int) -> np.ndarray:
        past = y[rows] * earlier[j]
        return np.concatenate([x[rows, j], past.sum(axis=1, keepdims=True), past, np.ones((len(rows), 1))], axis=1)

    def links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = fit_logistic(np.concatenate([design(rows, j) for j in range(k)]), np.concatenate([y[rows, j] for j in range(k)]), ridge)
        return common, np.stack([fit_logistic(design(rows, j), y[rows, j], own_ridge, common) for j in range(k)])

    rows = np.arange(len(x))
    _, w = links(rows)
    scale, shift = np.ones(k), np.zeros(k)
    folds = min(folds, len(x) // 8)
    if folds > 1:  # probabilities of labels that the links did not see; one fold is enough of many labels
        held, logits = [], []
        for fold in range(folds if len(x) < 2000 else 1):
            _, part = links(rows[rows % folds != fold])
            out = rows[rows % folds == fold]
            held.append(out)
            logits.append(np.stack([design(out, j) @ part[j] for j in range(k)], axis=1))
        held, logits = np.concatenate(held), np.clip(np.concatenate(logits), -12, 12)
        each = np.stack([logits.ravel(), np.ones(logits.size)], axis=1)
        common = fit_logistic(each, y[held].ravel(), 1.0, np.array([1.0, 0.0]))
        for j in range(k):
            scale[j], shift[j] = fit_logistic(np.stack([logits[:, j], np.ones(len(held))], axis=1), y[held, j], 5.0, common)
        scale = np.maximum(scale, 0.1)
    return Chain(order, w[:, :f], w[:, f : f + 1] * earlier + w[:, f + 1 : -1] * earlier, w[:, -1], scale, shift)


def subject_areas(
    docs: DataFrame,
    labels: DataFrame,
    subjects: DataFrame,
    most: int = 2,
    max_terms: int = 262144,
    max_labelled: int = 20000,
    max_langs: int = 16,
    max_sources: int = 64,
    rounds: int = 2,
    min_df: int = 2,
    first_least: float = 2.0,
    least: float = 6.0,
) -> DataFrame:
    """(doc_id, subject): one to `most` subjects for every document.

    docs: (doc_id, text, lang, source), labels: (doc_id, subject), subjects:
    (subject).  Labels are matched without regard to case and outer white space;
    unknown ones and labels of unknown documents count for nothing.  Without any
    label of a known subject and document nothing can be learned, and no rows come
    out.  A null or empty text gets the subject that is most likely without any
    evidence; rows without an id get none; a repeated id gets the subjects of each
    of its texts.  Copies of one text count together as one document, in the
    vocabulary and in the statistics.  The vocabulary holds the max_terms most
    frequent words of at least min_df documents; words common to all subjects get
    no weight.  The max_langs most frequent languages have expectations of their
    own, the others one in common; so have the max_sources sources most frequent
    among labels in the links.  The links are fitted on at most max_labelled
    labelled documents, all else comes from all documents.
    """
    spark = docs.sparkSession
    names = [r[0] for r in subjects.select("subject").dropna().distinct().orderBy("subject").collect()]
    out_schema = "doc_id long, subject string"
    if not names:
        return spark.createDataFrame([], out_schema)
    k = len(names)
    tasks = 4 * spark.sparkContext.defaultParallelism
    known = {s.strip().lower(): j for j, s in enumerate(names)}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), "source").filter("doc_id IS NOT NULL")
    base = spread(base)

    case = F.create_map(*[x for s, j in known.items() for x in (F.lit(s), F.lit(1 << j).cast("long"))])
    mask = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.try_element_at(case, F.lower(F.trim("subject"))).alias("bit"))
    mask = mask.dropna().groupBy("doc_id").agg(F.bit_or("bit").alias("mask"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed, chars, code, marked, key = [], [], [], [], []
            for text in pdf["text"]:
                text = text or ""
                key.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
                h = _term_ids(term_stream(text))
                packed.append(h[(h != 0) | (np.append(np.uint64(0), h[:-1]) != 0)].tobytes() if len(h) else b"")
                lines = text.split("\n")
                chars.append(float(len(text)))
                code.append(sum(x[:1] in " \t" and bool(x.strip()) for x in lines) / len(lines))
                marked.append(sum(x[:1] in "#-*>@$" and bool(x) for x in lines) / len(lines))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "source": pdf["source"], "terms": packed, "chars": chars, "code": code, "marked": marked, "key": key})

    texts = base.mapInPandas(read, "doc_id long, lang string, source string, terms binary, chars double, code double, marked double, key long")
    read_once = written(texts.join(mask, "doc_id", "left"), "texts")
    copies = written(read_once.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "copies")
    texts = read_once.join(copies, "key", "left").withColumn("share", 1 / F.coalesce("members", F.lit(1))).drop("key", "members")
    langs = {r["lang"]: j + 1 for j, r in enumerate(texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect())}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pd.DataFrame:
            term, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(term))
            return pd.DataFrame({"term": term.view(np.int64), "df": n})

        for pdf in batches:
            parts = [np.unique(np.frombuffer(x, np.uint64)) for x in pdf["terms"]]
            if parts:
                held.append((np.concatenate(parts), np.repeat(pdf["share"].to_numpy(), [len(x) for x in parts])))
            if sum(len(t) for t, _ in held) > 4_000_000:
                both = merged()
                if len(both) > 2_000_000:
                    yield both
                    held.clear()
                else:
                    held[:] = [(both["term"].to_numpy().view(np.uint64), both["df"].to_numpy())]
        if held:
            yield merged()

    df = texts.select("terms", "share").coalesce(tasks).mapInPandas(count, "term long, df double").filter("term <> 0").groupBy("term").agg(F.round(F.sum("df"), 6).alias("df"))
    chosen = df.filter(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(max_terms).select("term")
    vocabulary = np.sort(np.array([r[0] for r in chosen.collect()], dtype=np.int64).view(np.uint64))
    ids = spark.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = ids.value
        for pdf in batches:
            packed = []
            for raw in pdf["terms"]:
                h = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
                hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
                j = np.append(np.where(hit, at, -1).astype(np.int32)[hit | (h == 0)], np.int32(-1))
                packed.append(j[(j >= 0) | (np.append(np.int32(0), j[:-1]) >= 0)].tobytes())
            lang = [langs.get(g, 0) for g in pdf["lang"]]
            yield pdf.drop(columns="terms").assign(stream=packed, lang=lang)[["doc_id", "lang", "source", "stream", "chars", "code", "marked", "mask", "share"]]

    rows = written(texts.mapInPandas(numbered, "doc_id long, lang int, source string, stream binary, chars double, code double, marked double, mask long, share double"), "streams")
    dropped(read_once)
    dropped(copies)
    labelled = rows.filter("mask IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas()
    v, n_langs = max(1, len(vocabulary)), len(langs) + 1
    if labelled.empty:
        return spark.createDataFrame([], out_schema)
    start = _evidence(*statistics(None, labelled, k, v, n_langs), first_least)
    ev, before = learn_evidence(rows, start, rounds, least, tasks)
    sources = {s: j for j, s in enumerate(labelled["source"].dropna().value_counts().index[:max_sources])}
    x, count_of = features(ev, labelled, sources, before)
    chain = fit_chain(x, (_marks(labelled["mask"].to_numpy(), k) > 0).astype(float), count_of)
    ev.counts = None
    model = spark.sparkContext.broadcast((ev, chain))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ev, chain = model.value
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000].reset_index(drop=True)
                r, c = np.nonzero(chain.decode(features(ev, part, sources)[0], most=most))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[r], "subject": np.array(names, dtype=object)[c]})

    return rows.mapInPandas(decide, out_schema).distinct()
