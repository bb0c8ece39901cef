"""Main body of Markdown pages, by composite text density.

A page becomes a tree: its title and headings span sections, sections hold blocks,
blocks hold lines, lines hold inline tags.  Every node gets a composite text
density: visible characters per tag, adjusted by the share of navigational
characters and tags below it.  Densities of children are summed; the branch of the
subtree with the largest sum is the main body, and the least density on the way
from the root to that subtree is the threshold for all containers outside it.
Inside the body a block goes where link adjustment leaves less than half of its
characters per tag.

In Markdown furniture need not be made of links, so navigational characters are
those of links within the site (anchors, targets that repeat their own text), of
blocks whose form is that of menus, paths, date and share lines, and, in part, of
text in the words of furniture.  These words are not listed but learned, in
whatever languages the pages have: what pages show above their own title and in
furniture by form, against the rest of their text (naive Bayes, whose probability
is the share of a block's characters that counts as navigational).  Links of an
article, in lists too, lead elsewhere and count as text.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.runtime import dropped, spread, written

_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\(([^()\s]*(?:\([^()]*\))?)[^()]*\)")
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_HEAD = re.compile(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_RULE = re.compile(r"^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_DATE = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b")
_MINUTES = re.compile(r"\b\d+\s*min\b", re.I)
_CRUMB = re.compile(r"\s+[>›»/→]\s+")
_MARKS = re.compile(r"[*_]{1,3}(?=\S)|(?<=\S)[*_]{1,3}(?=\W|$)")
_SENTENCE = re.compile(r"[.!?:;]\s|[.!?;]$")
_WORDISH = re.compile(r"\w")
_WORD = re.compile(r"[^\W\d_]+")
_SPAN = re.compile(r"`[^`\n]*`")
_SPECIAL = re.compile(r"[←→«»⟵⟶›|·•©]| [>/] |opyright|\(c\)")
_CELL = re.compile(r"\s+[·|•]\s+")
_NUMBER = re.compile(r"^\s*\d{1,3}[.)]\s")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b")


def _is_rule(line: str) -> bool:
    return not line.strip(" -*_\t") and _RULE.match(line) is not None


def _plain(text: str) -> str:
    """Visible text without link targets, emphasis, quote and heading marks."""
    if "](" in text:
        text = _LINK.sub(lambda m: "" if m[1] else m[2], text)
    text = text.strip().lstrip("># ").strip()
    return _MARKS.sub("", text).strip() if "*" in text or "_" in text else text


def _slug(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


def _leads_nowhere(label: str, target: str) -> bool:
    """A link of the site's own furniture: an anchor, or one path segment that repeats the label."""
    if target.startswith("#") or not target:
        return True
    path = re.sub(r"^https?://[^/]+", "", target).strip("/").split("?")[0].split("#")[0]
    if "/" in path:
        return False
    own, label = _slug(path), _slug(label)
    return bool(own) and (label.startswith(own) or own.startswith(label[:12]) and len(label) > 0)


@dataclass
class Block:
    """Lines [first, last) with what they are, and the counts of the density."""

    first: int
    last: int
    kind: str  # code, table, heading, text
    level: int = 0
    chars: int = 0
    tags: int = 1
    nav_chars: float = 0
    nav_tags: float = 0
    form: bool = False


@dataclass
class Node:
    """A section: its blocks and subsections."""

    level: int
    blocks: list[Block] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)
    total: tuple[float, float, float, float] | None = None


def split_blocks(lines: list[str]) -> list[Block]:
    """Blocks of a page; a fence reaches to its closing fence, an unclosed one to the next empty line."""
    out, i, n = [], 0, len(lines)
    while i < n:
        if not lines[i].strip():
            i += 1
            continue
        fence = _FENCE.match(lines[i])
        if fence:
            end = next((j for j in range(i + 1, n) if lines[j].strip().startswith(fence[1][:3]) and not lines[j].strip().strip(fence[1][0])), None)
            if end is not None:
                out.append(Block(i, end + 1, "code"))
                i = end + 1
                continue
        j = i
        while j < n and lines[j].strip() and not (j > i and _FENCE.match(lines[j])):
            j += 1
        rows = lines[i:j]
        if fence or all(x.startswith(("    ", "\t")) for x in rows):
            out.append(Block(i, j, "code"))
        elif rows[0].lstrip().startswith("|") and all(_TABLE.match(x) for x in rows):
            out.append(Block(i, j, "table"))
        else:
            head = _HEAD.match(rows[0]) if len(rows) == 1 and "#" in rows[0] else None
            if head:
                out.append(Block(i, j, "heading", level=len(head[1])))
            else:
                out.append(Block(i, j, "text"))
        i = j
    return out


class Page:
    """A page with its blocks measured, by form alone; `words` of a block are what learned evidence refers to."""

    def __init__(self, text: str, title: str | None, url: str | None):
        self.lines = [x.rstrip("\r") for x in text.split("\n")]
        host = re.sub(r"^https?://", "", url or "").split("/")[0].split(":")[0].lower()
        labels = [x for x in host.split(".") if x not in ("www", "docs", "blog", "m", "en", "news")]
        self.site = labels[-2] if len(labels) > 1 else (labels[0] if labels else "")
        self.title = _plain(re.split(r"\s+[-|·—–:]\s+(?=[^-|·—–]*$)", title or "")[0]).lower()
        self.blocks = split_blocks(self.lines)
        for b in self.blocks:
            self._measure(b)
        self.top = self._title_block()

    def _title_block(self) -> int | None:
        """The block that repeats the page's title, else the first heading of level 1 that is no logo; None without either."""
        heads = [i for i, b in enumerate(self.blocks) if b.kind == "heading" and b.level == 1 and not b.form]
        if self.title:
            for i, b in enumerate(self.blocks):
                if b.kind in ("heading", "text") and not b.form and b.last == b.first + 1 and _plain(self.lines[b.first]).lower() == self.title:
                    return i
        return heads[0] if heads else None

    def _is_site(self, text: str) -> bool:
        if not self.site or len(text) > 2 * len(self.site) + 16:
            return False
        return re.sub(r"\W", "", text.lower()) in (self.site.replace("-", ""), self.site.replace("-", "") + "docs", self.site.replace("-", "") + "blog")

    def _measure(self, b: Block) -> None:
        rows = self.lines[b.first : b.last]
        text = "\n".join(rows)
        b.chars = len(text) - text.count(" ") - text.count("\n")
        if b.kind in ("code", "table"):
            b.tags = len(rows) if b.kind == "table" else 1
            return
        links = _LINK.findall(text) if "](" in text else []
        b.tags = max(1, len(rows) + len(links))
        b.form = self._is_site(_plain(rows[0])) if b.kind == "heading" else self._navigational(b, rows, links)
        if b.form:
            b.nav_chars, b.nav_tags = b.chars, b.tags
        elif links:
            own = [len(x[1]) for x in links if not x[0] and _leads_nowhere(x[1], x[2])]
            b.nav_chars, b.nav_tags = min(b.chars - 1, sum(own)), len(own)

    def head(self, b: Block) -> str | None:
        """The short line that stands over the items of a block, or before a row of them; a heading itself."""
        if b.kind == "heading":
            return _plain(self.lines[b.first])
        rows = [x for x in self.lines[b.first : b.last] if not _is_rule(x)]
        if not rows or _ITEM.match(rows[0]) or len(rows) == 1 and not _CELL.search(rows[0]):
            return None
        first = _plain(rows[0])
        if not first:
            return None
        if len(rows) > 1 and len(first.split()) <= 6 and not _SENTENCE.search(first.rstrip(":")) and all(_ITEM.match(x) or _LINK.match(x.strip()) for x in rows[1:]):
            return first
        before, colon, after = first.partition(":")
        if colon and len(rows) <= 2 and len(before.split()) <= 4 and len(_CELL.split(after)) > 1:
            return before
        return None

    def words(self, b: Block) -> set[str]:
        """What learned evidence refers to: the head of a block that has one, else its distinct words, and marks of its form."""
        head = self.head(b)
        if head is not None:
            return {"h:" + " ".join(head.lower().rstrip(": ").split()), "#" if b.kind == "heading" else "h"}
        text = "\n".join(self.lines[b.first : b.last])
        code = "`" in text
        bare = _SPAN.sub(" ", text) if code else text
        out = set(_WORD.findall((_LINK.sub(lambda m: m[2], bare) if "](" in bare else bare).lower()))
        out.discard(self.site)
        out.add("`" if code else "``")
        first = next((x for x in self.lines[b.first : b.last] if not _is_rule(x)), "").strip()
        out.add("*" if first.startswith("**") else ">" if first.startswith(">") else "-" if _ITEM.match(first) else "a")
        out.add("." if _SENTENCE.search(first) else "..")
        return out

    def _navigational(self, b: Block, rows: list[str], links: list[tuple[str, str, str]]) -> bool:
        """Whether all text of a block is site furniture by its form, in any language."""
        body = [x for x in rows if not _is_rule(x)]
        if not body:
            return False
        items = [bool(_ITEM.match(x)) for x in body]
        if not links:  # sentences, and lists without links, have none of the forms below
            if all(items) and not any(_RIGHTS.search(x.lower()) for x in body):
                return False
            if all(len(x) >= 40 and x[-1] in ".!?:;" for x in body) and not any(_SPECIAL.search(x) for x in body):
                return False
        code = any("`" in x for x in body)
        bare = [_plain(x) for x in body]
        low = [x.lower() for x in bare]
        joined = " ".join(low)

        # links of the site alone: menus, skip links, buttons, share lines, boxes of links
        if links:
            rest = " ".join(_LINK.sub(" ", _ITEM.sub("", x)) for x in body)
            rest = re.sub(r"\(\d+\)|[|·•>›»/,*_\-]", " ", rest).split()
            nowhere = [_leads_nowhere(x[1], x[2]) for x in links if not x[0]]
            if not rest and all(nowhere):
                return True
            headed = not _LINK.search(body[0]) and not items[0] and not _SENTENCE.search(bare[0])
            if headed and len(body) > 1 and nowhere and all(nowhere) and all(_LINK.search(x) for x in body[1:]) and sum(map(len, rest)) <= len(bare[0]) + 4 * len(body):
                return True
            if rest and all(nowhere) and len(" ".join(rest)) < 12 and not code and not any(items):
                return True
        # a mail field or a button that belongs to a box
        if 1 < len(body) <= 4 and not code and any(x.strip() in ("@", ">>", "OK") or re.fullmatch(r"\[[^\]]*\]\(#\)", x.strip()) for x in body[1:]):
            return True
        # arrows to neighbouring pages
        if len(body) <= 2 and all(x.startswith(("←", "« ", "<- ", "⟵")) or x.endswith(("→", " »", " ->", "⟶")) for x in bare):
            return True
        # a short heading in plain text with numbered titles below it
        if len(body) > 1 and not items[0] and not body[0].lstrip().startswith((">", "#")) and not _SENTENCE.search(bare[0]) and len(low[0].split()) <= 4 and "`" not in low[0] and all(_NUMBER.match(x) for x in body[1:]) and not any(x.endswith((".", "!", "?", ";")) for x in bare[1:]):
            return True
        # paths through the site
        if len(body) == 1:
            crumbs = _CRUMB.split(re.sub(r"^\s*>\s+", "", body[0]).strip())
            if len(crumbs) >= 3 and all(len(_plain(x).split()) <= 3 and not _SENTENCE.search(_plain(x)) for x in crumbs[:-1]) and not items[0]:
                last = _plain(crumbs[-1]).lower()
                if not code or (self.title and (last == self.title or last.startswith(self.title[:20]))) or all("`" not in x for x in crumbs[:-1]):
                    return True
        # lines without letters (counters of a share line), dates and reading times
        if all(not re.search(r"[^\W\d_]", x) for x in bare) and len(joined) <= 40 and not any(items) and (any(unicodedata.category(c) == "So" for c in joined) or joined in ("@", ">>")):
            return True
        if code:
            return False
        if len(body) == 1 and len(low[0].split()) <= 9 and _DATE.search(low[0]) and (_MINUTES.search(low[0]) or "·" in low[0] or len(low[0].split()) <= 4):
            return True
        # the site's name with menu items below, as a logo line, or in a closing line
        if _HEAD.match(body[0]) and len(body) > 1 and self._is_site(bare[0]) and all(len(x.split()) <= 3 and not _SENTENCE.search(x) for x in bare[1:]):
            return True
        if len(body) == 1 and len(low[0].split()) <= 3 and self.site and re.search(rf"\b{re.escape(self.site)}\b", low[0]) and not _SENTENCE.search(bare[0]) and self._is_site(re.sub(r"^\S{1,2}\s+|\s+(?:19|20)\d\d$", "", bare[0])):
            return True
        if any(_RIGHTS.search(x) for x in low) and all(len(p.split()) <= 7 for x in low for p in re.split(r"\s*[·|•]\s*|\.\s+|,\s+", x)):
            return True
        # menus of plain words
        if len(body) <= 2 and not any(items) and not any(_SENTENCE.search(x) for x in bare) and (len(bare) == 1 or len(bare[1].split()) <= 3):
            parts = [p for p in re.split(r"\s*[|·•]\s*", bare[0]) if p]
            if len(parts) >= 3 and all(len(p.split()) <= 3 for p in parts) and sum(p[:1].isupper() for p in parts) >= 0.7 * len(parts):
                return True
            parts = bare[0].split()
            if len(parts) >= 3 and all(p[:1].isupper() and _WORDISH.match(p) for p in parts) and self.title != low[0]:
                return True
        return False


#: Inside the main body a block goes if link adjustment leaves less than this of its characters per tag.
NAVIGATIONAL = 0.5


@dataclass
class Furniture:
    """Learned evidence: log likelihood ratios of words for furniture against article text, and the prior log odds."""

    ratio: dict[str, float] = field(default_factory=dict)
    prior: float = -2.0

    def share(self, words: Iterable[str]) -> float:
        """Share of a block's characters that counts as navigational by its words."""
        if not self.ratio:
            return 0.0
        known = {w: self.ratio[w] for w in words if w in self.ratio}
        if not any(w[:1].isalpha() for w in known):
            return 0.0
        s = self.prior + sum(known.values())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


@dataclass
class Parts:
    """What evidence and densities need of a page: blocks, their words (none for code and tables), which are rules, and empty lines inside them."""

    top: int | None
    blocks: list[Block]
    words: list[list[str] | None]
    rules: list[bool]
    empty: list[int]

    @classmethod
    def of(cls, page: Page) -> Parts:
        lines, blocks = page.lines, page.blocks
        words = [sorted(page.words(b)) if b.kind in ("text", "heading") else None for b in blocks]
        rules = [all(_is_rule(x) for x in lines[b.first : b.last]) for b in blocks]
        return cls(page.top, blocks, words, rules, [i for b in blocks if b.kind == "code" for i in range(b.first, b.last) if not lines[i].strip()])

    def packed(self) -> bytes:
        rows = [(b.first, b.last, b.kind, b.level, b.chars, b.tags, b.nav_chars, b.nav_tags, b.form) for b in self.blocks]
        return pickle.dumps((self.top, rows, [None if w is None else "\n".join(w) for w in self.words], self.rules, self.empty), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> Parts:
        top, rows, words, rules, empty = pickle.loads(data)
        return cls(top, [Block(*x) for x in rows], [None if w is None else w.split("\n") for w in words], rules, empty)


def word_counts(pages: list[tuple[str | None, str | None, str | None]], known: Furniture) -> dict[str, list[int]]:
    """count_words() of (text, title, url) rows."""
    return count_words((Parts.of(Page(*x)) for x in pages if x[0] and x[0].strip()), known)


def count_words(pages: Iterable[Parts], known: Furniture) -> dict[str, list[int]]:
    """Blocks of each word that are furniture, and that are article text, as far as form, place and known evidence say; "" counts all.

    What stands above the page's own title and what is furniture by form counts as
    furniture, all other text as article text.
    """
    nav, body = Counter(), Counter()
    for page in pages:
        for i, (b, words) in enumerate(zip(page.blocks, page.words)):
            if words is None:
                continue
            own = body
            if b.form or (page.top is not None and i < page.top) or known.share(words) > 0.5:
                own = nav
            own.update(words)
            own[""] += 1
    return {w: [nav[w], body[w]] for w in nav.keys() | body.keys()}


def evidence(counts: dict[str, tuple[float, float]]) -> Furniture:
    """Furniture from block counts of words."""
    nav, text = counts.get("", (0, 0))
    if not nav or not text:
        return Furniture()
    ratio = {w: math.log((a + 0.5) / (nav + 1)) - math.log((b + 0.5) / (text + 1)) for w, (a, b) in counts.items() if w and a + b >= 3}
    return Furniture(ratio, math.log(nav / text))


def _density(chars: float, tags: float, nav_chars: float, nav_tags: float, body: tuple[float, float]) -> float:
    """Composite text density: characters per tag, times a logarithm that vanishes where all is navigational."""
    if not chars:
        return 0.0
    tags, nav_tags = max(1.0, tags), max(1.0, nav_tags)
    plain = max(chars - nav_chars, 1.0)
    nav = max(nav_chars, 1.0)
    base = math.log(chars / plain * nav + body[0] / max(body[1], 1.0) * chars + math.e)
    value = (chars / nav) * (tags / nav_tags)
    return chars / tags * (math.log(value) / math.log(max(base, 1.0001)) if value > 1 else 0.0)


def _totals(node: Node) -> tuple[float, float, float, float]:
    """Characters, tags, navigational characters and tags of a finished node."""
    if node.total is None:
        parts = [(b.chars, b.tags, b.nav_chars, b.nav_tags) for b in node.blocks] + [_totals(s) for s in node.below]
        node.total = tuple(sum(x) + extra for x, extra in zip(zip(*parts) if parts else ((), (), (), ()), (0, 1, 0, 0)))
    return node.total


def _blocks_below(node: Node) -> list[Block]:
    return node.blocks + [b for s in node.below for b in _blocks_below(s)]


def outside_lines(text: str | None, title: str | None = None, url: str | None = None, known: Furniture | None = None) -> list[int]:
    """Numbers (from 1) of the lines that are not of the main body; empty lines are never among them."""
    if not text or not text.strip():
        return []
    return outside_parts(Parts.of(Page(text, title, url)), known)


def outside_parts(page: Parts, known: Furniture | None = None) -> list[int]:
    """outside_lines() of a page that is measured."""
    for b, words in zip(page.blocks, page.words):
        if known is not None and not b.form and words is not None:
            share = known.share(words)
            b.nav_chars, b.nav_tags = max(b.nav_chars, share * b.chars), max(b.nav_tags, share * b.tags)
    root = Node(0)
    stack = [root]
    for i, b in enumerate(page.blocks):
        if i == page.top or b.kind == "heading" and b.nav_chars < b.chars / 2:
            level = b.level or 1
            while stack[-1].level >= level:
                stack.pop()
            node = Node(level)
            stack[-1].below.append(node)
            stack.append(node)
        stack[-1].blocks.append(b)
    whole = _totals(root)
    body = (whole[2], whole[0])
    weigh = {id(b): _density(b.chars, b.tags, b.nav_chars, b.nav_tags, body) for b in page.blocks}

    # the subtree with the largest sum of the densities below it; its path to the root gives the threshold
    best, best_sum, limit = root, -1.0, 0.0
    todo = [(root, root, float("inf"))]
    while todo:
        node, branch, least = todo.pop()
        least = min(least, _density(*_totals(node), body))
        total = sum(weigh[id(b)] for b in node.blocks) + sum(_density(*_totals(s), body) for s in node.below)
        if total > best_sum:
            best, best_sum, limit = branch, total, least
        todo += [(s, s if branch is root else branch, least) for s in node.below]

    # the rest of its branch belongs to it; other branches, and what stands together between furniture above all
    # headings, are containers that have to reach the threshold as a whole
    fallen: set[int] = set()
    if best is not root:
        containers = [_blocks_below(s) for s in root.below if s is not best] + [[]]
        for b in root.blocks:
            if b.form:
                containers.append([])
            else:
                containers[-1].append(b)
        for some in containers:
            some = [b for b in some if not b.form]
            if some and _density(*(sum(x) for x in zip(*((b.chars, b.tags, b.nav_chars, b.nav_tags) for b in some))), body) < limit:
                fallen |= {id(b) for b in some}
    drop = [id(b) in fallen or weigh[id(b)] < NAVIGATIONAL * b.chars / b.tags for b in page.blocks]
    out, empty = [], set(page.empty)
    for k, b in enumerate(page.blocks):
        gone = (drop[k + 1] if k + 1 < len(drop) else True) if page.rules[k] else drop[k]
        if gone:
            out += [i + 1 for i in range(b.first, b.last) if i not in empty]
    return out


def main_body(text: str | None, title: str | None = None, url: str | None = None, known: Furniture | None = None) -> str | None:
    """The lines of the main body, with runs of empty lines joined into one; None for a null text."""
    if text is None:
        return None
    gone = set(outside_lines(text, title, url, known))
    kept = [x.rstrip("\r") for i, x in enumerate(text.split("\n"), 1) if i not in gone]
    return re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", "\n".join(kept)).strip("\n")


def _own(pages: DataFrame, id_col: str, text_col: str, title_col: str, url_col: str) -> DataFrame:
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(title_col).alias("title"), F.col(url_col).alias("url"))
    return own.filter("id IS NOT NULL")


def _measured(own: DataFrame) -> DataFrame:
    """(id, parts), a table of the pages with text, each parsed once; parts take about three quarters of the bytes of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.loc[[bool(x.strip()) for x in pdf["text"]]]
            yield pd.DataFrame({"id": pdf["id"], "parts": [Parts.of(Page(*x)).packed() for x in pdf[["text", "title", "url"]].itertuples(index=False, name=None)]})

    return written(spread(own.filter("text IS NOT NULL")).mapInPandas(run, "id long, parts binary"), "pages")


def learn_furniture(pages: DataFrame, id_col: str, text_col: str, title_col: str, url_col: str, sample_pages: int | None = None, max_words: int = 65536, rounds: int = 2) -> Furniture:
    """Evidence of words, fitted on all pages; the driver holds max_words words.

    The pages label their own blocks: what is furniture by form or stands above the
    title, against the rest.  Each further round also counts as furniture what the
    evidence of the round before finds.  An empty table gives no evidence.  Only
    where sample_pages is given, about so many pages are drawn by a hash of their id.
    """
    own = _own(pages, id_col, text_col, title_col, url_col).filter("text IS NOT NULL")
    n = own.count() if sample_pages is not None else 0
    if sample_pages is not None and n > sample_pages:
        own = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil((1 << 20) * sample_pages / n))
    parts = _measured(own)
    known = _learned(parts, max_words, rounds)
    dropped(parts)
    return known


def _learned(parts: DataFrame, max_words: int = 65536, rounds: int = 2) -> Furniture:
    """learn_furniture() of pages that are measured."""
    known, spark = Furniture(), parts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(known)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = count_words(map(Parts.unpacked, pdf["parts"]), shared.value)
                yield pd.DataFrame([(w, *x) for w, x in got.items()], columns=["word", "nav", "body"]).astype({"nav": "int64", "body": "int64"})

        sums = spread(parts.select("parts")).mapInPandas(count, "word string, nav long, body long").groupBy("word").agg(F.sum("nav").alias("nav"), F.sum("body").alias("body"))
        top = sums.filter("nav + body >= 3").orderBy(F.desc(F.col("nav") + F.col("body")), "word").limit(max_words)
        rows = top.filter("word IS NOT NULL").collect()  # a step after the limit, so that a task makes the choice and not the driver
        known = evidence({r["word"]: (r["nav"], r["body"]) for r in rows})
    return known


def boilerplate_lines(pages: DataFrame, id_col: str, text_col: str, title_col: str, url_col: str, known: Furniture | None = None) -> DataFrame:
    """(id, line_no) of the lines outside the main body; every page is parsed once, into a table, and never shuffled by a key.

    Null and blank texts have no such lines; rows without an id are left out;
    repeated ids give the lines of each of their texts.  Without `known` the
    evidence is learned from all the pages themselves.
    """
    parts = _measured(_own(pages, id_col, text_col, title_col, url_col))
    shared = pages.sparkSession.sparkContext.broadcast(known or _learned(parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, at = [], []
            for i, data in zip(pdf["id"].tolist(), pdf["parts"]):
                got = outside_parts(Parts.unpacked(data), shared.value)
                ids += [i] * len(got)
                at += got
            yield pd.DataFrame({"id": ids, "line_no": at}).astype({"id": "int64", "line_no": "int32"})

    return spread(parts).mapInPandas(run, "id long, line_no int")


def main_bodies(pages: DataFrame, id_col: str, text_col: str, title_col: str, url_col: str, known: Furniture | None = None) -> DataFrame:
    """(id, body) for every row with an id; a null text has a null body."""
    known = known or learn_furniture(pages, id_col, text_col, title_col, url_col)
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "body": [main_body(*x, shared.value) for x in pdf[["text", "title", "url"]].itertuples(index=False)]})

    return spread(_own(pages, id_col, text_col, title_col, url_col)).mapInPandas(run, "id long, body string")
