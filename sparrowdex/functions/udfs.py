"""Functions that no column expression covers, as Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import html
import json
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowdex.functions.text import CODE_WORDS, FOLDABLE, TRIVIAL_CONDITIONS

DIM = 384
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> int:
    """64-bit FNV-1a of the UTF-8 bytes."""
    h = _FNV_START
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * _FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embedding(text: str, dim: int = DIM) -> np.ndarray:
    """Deterministic unit vector: FNV-1a seeds a xorshift generator whose low 32 bits are the components."""
    x = fnv1a(text) or 1
    out = np.empty(dim)
    for i in range(dim):
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        low = x & 0xFFFFFFFF
        out[i] = (low - (1 << 32) if low >= 1 << 31 else low) / 2147483647.0
    n = np.linalg.norm(out)
    return (out / n if n > 0 else out).astype(np.float32)


@F.pandas_udf(T.LongType())
def fnv1a_64(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fnv1a(t) - (1 << 64) if fnv1a(t) >= 1 << 63 else fnv1a(t)).astype("Int64")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: pd.Series) -> pd.Series:
    known = {t: hash_embedding(t).tolist() for t in set(text.dropna())}  # equal texts are embedded once a batch
    return text.map(lambda t: None if t is None else known[t])


def main_element(page: str) -> str | None:
    """Inner HTML of the first article, else of the first main element, with nested ones balanced."""
    for tag in ("article", "main"):
        depth, start = 0, None
        for m in re.finditer(rf"<(/?){tag}(?=[\s>/])[^>]*>", page, re.I):
            if not m[1]:
                if start is None:
                    start = m.end()
                depth += 1
            elif start is not None:
                depth -= 1
                if depth == 0:
                    return page[start : m.start()].strip()
    return None


class _Markdown(HTMLParser):
    """Collects Markdown from HTML; scripts, styles and noscript parts fall away."""

    HIDDEN = ("script", "style", "noscript", "template")
    BLOCK = ("p", "div", "section", "article", "main", "header", "footer", "table", "tr", "ul", "ol", "blockquote", "pre", "br", "hr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.href = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in self.BLOCK:
            self.out.append("\n" if tag == "br" else "\n\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in self.BLOCK or tag[:1] == "h" and tag[1:].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(page: str) -> str:
    p = _Markdown()
    p.feed(page)
    p.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NO_PAGE = ("javascript:", "mailto:", "tel:", "data:")


def page_links(base: str, page: str) -> list[str]:
    """Absolute http(s) links of a page without fragments, in order, each once; none for a base that is no URL."""
    if not re.match(r"https?://[^/\s]+", base):
        return []
    seen: dict[str, None] = {}
    for m in _HREF.finditer(page):
        raw = html.unescape(next(g for g in m.groups() if g is not None)).strip()
        if not raw or raw.startswith("#") or raw.lower().startswith(_NO_PAGE):
            continue
        try:
            url = urldefrag(urljoin(base, raw))[0]
        except ValueError:
            continue
        if url.startswith(("http://", "https://")):
            seen.setdefault(url)
    return list(seen)


def thread_to_markdown(body: str, most: int = 5) -> tuple[str, str] | None:
    """Title and Markdown of a discussion thread in its JSON listing form, with the first comments; None for another shape."""
    try:
        data = json.loads(body)
        post = data[0]["data"]["children"][0]["data"]
        title = post["title"]
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    if not isinstance(title, str):
        return None
    text, link = (post.get("selftext") or "").strip(), post.get("url") or ""
    out = [f"**r/{post.get('subreddit') or '?'}**  \\| u/{post.get('author') or '?'} \\| score {post.get('score') or 0}"]
    out += [text] if text else [f"link: {link}"] if link else []
    try:
        below = data[1]["data"]["children"]
    except (KeyError, IndexError, TypeError):
        below = None
    if below is not None:
        out += ["---", "## Top comments"]
        for c in below[:most]:
            d = c.get("data") or {}
            said = (d.get("body") or "").strip()
            if said:
                out.append(f"**u/{d.get('author') or '?'}** ({d.get('score') or 0}):\n{said}")
    return title, "\n\n".join(out)


_WHITE = " \t\r\n\f"


def _lines(text: str) -> list[str]:
    rows = text.removesuffix("\n").split("\n") if text else []
    return [x.removesuffix("\r") for x in rows]


def _disruption(before: list[str], after: list[str]) -> float:
    """Share of the lines of the longer text that the rewrite does not keep."""
    known, most = set(before), max(len(before), len(after))
    return 1 - sum(x in known for x in after) / most if most else 0.0


def compact_text(text: str, least: int = 0, most_disruption: float = 1.0) -> tuple[str, list[str], float]:
    """A text after the rules that save enough, their names in order, and how far it was disrupted.

    Each rule looks at the lines of the original text.  Findings that save fewer than
    `least` tokens (a quarter of the bytes) count for nothing; a rule with findings
    rewrites the text as a whole, dead code only by its own findings.  A result that
    is disrupted beyond the limit is given up for the original.
    """
    rows = _lines(text)
    bare = [x.strip(_WHITE) for x in rows]
    size = lambda x: len(x.encode("utf-8", "surrogatepass"))
    first = lambda x, forms: next((f for f in forms if f in x), None)
    worth, run = False, 1
    for k in range(1, len(bare) + 1):
        if k < len(bare) and bare[k] and bare[k] == bare[k - 1]:
            run += 1
            continue
        worth |= run > 1 and size(bare[k - 1]) * (run - 1) // 4 >= least
        run = 1
    conditions = [c for x in bare if (c := first(x, TRIVIAL_CONDITIONS)) and len(c) // 4 >= least]
    dead = {x for x in bare if x.startswith("// ") and any(w in x[3:] for w in CODE_WORDS) and size(x) // 4 >= least}
    folds = any(len(f) // 4 >= least for x in rows if (f := first(x, [a for a, _ in FOLDABLE])))
    blanks = any(x and not x.strip(" \t") and len(x) // 4 >= least for x in rows)
    rules, out = [], text
    if worth:
        rules.append("repeats")
        own = _lines(out)
        out = "\n".join(x for k, x in enumerate(own) if not k or x != own[k - 1])
    if conditions:
        rules.append("conditions")  # found and counted, never rewritten
    if dead:
        rules.append("dead code")
        form = re.compile("|".join(map(re.escape, sorted(dead, key=len))))
        out = "\n".join(x for x in _lines(out) if not form.search(x))
    if folds:
        rules.append("folds")
        for a, b in FOLDABLE:
            out = out.replace(a, b)
    if blanks:
        rules.append("blanks")
        out = "\n".join(x for x in _lines(out) if x.strip(_WHITE))
    far = _disruption(rows, _lines(out)) if rules else 0.0
    return (text, [], 0.0) if rules and far > most_disruption else (out, rules, far)


def compact(least: int = 0, most_disruption: float = 1.0):
    """compact_text() as a function of a column: struct<text, rules, disruption>, null for a null text."""

    @F.pandas_udf("text string, rules array<string>, disruption double")
    def run(text: pd.Series) -> pd.DataFrame:
        got = [(None, None, None) if t is None else compact_text(t, least, most_disruption) for t in text]
        return pd.DataFrame(got, columns=["text", "rules", "disruption"])

    return run


def _trigram_set(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) if len(b) > 2 else np.empty(0, np.uint32)


@F.pandas_udf(T.DoubleType())
def trigram_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of the byte trigrams of two texts, 1 for two without any; null for a null text."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = _trigram_set(x), _trigram_set(y)
        both = len(np.intersect1d(p, q, assume_unique=True))
        union = len(p) + len(q) - both
        return both / union if union else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def unified_diff(old: str, new: str, label: str = "text", context: int = 3) -> str:
    """Unified diff of two texts by lines."""
    return "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), f"a/{label}", f"b/{label}", lineterm="", n=context))


def _one(fn):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else fn(t))

    return run


main_element_of = _one(main_element)
markdown_of = _one(html_to_markdown)
thread_of = _one(lambda t: (thread_to_markdown(t) or (None, None))[1])


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_of(base: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else page_links(b or "", p) for b, p in zip(base, page)])


@F.pandas_udf(T.StringType())
def diff_of(old: pd.Series, new: pd.Series) -> pd.Series:
    """The diff of two texts where it is shorter than the new one, else the new text itself; null for a null text."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        told = unified_diff(a, b)
        return told if len(told) < len(b) else b

    return pd.Series([one(a, b) for a, b in zip(old, new)])
