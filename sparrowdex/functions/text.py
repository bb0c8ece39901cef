"""Text functions as column expressions: token counts, line rules, rewrites, windows, sanitisers.

All of them stay in the JVM; null texts give null.  Lines are what stands between
line feeds, without a carriage return at the end; a final line feed opens no line
and an empty text has none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
PUNCTUATION = "{}();,.<>=!&|+-*/"
TRIVIAL_CONDITIONS = ("if true {", "if false {", "if 1 == 1 {", "if 0 == 0 {")
CODE_WORDS = ("let ", "fn ", "return ", "if ", "for ", "while ", "match ")
FOLDABLE = (("1 + 0", "1"), ("0 + 1", "1"), ("x * 1", "x"), ("1 * x", "x"), ("x + 0", "x"), ("0 + x", "x"), ("x - 0", "x"), ("x / 1", "x"))
ERROR_MARKS = ("error", "Error", "ERROR", "warning", "Warning", "WARN", "panic", "PANIC", "failed", "FAILED", "exception", "Exception")
WHITE = r"[ \t\r\n\f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often and in whatever lambda the body uses it."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """Array of the lines of a text."""
    body = F.regexp_replace(text, r"\n\z", "")
    rows = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(rows)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}|{WHITE}\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE, -1), lambda x: x != "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a text are among the given ones."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def token_count(text: Column) -> Column:
    """Words and a third of the punctuation marks."""
    return F.size(words(text)) + F.floor(count_of(text, PUNCTUATION) / 3)


def byte_tokens(text: Column) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4)


def line_tokens(line: Column) -> Column:
    """A quarter of the bytes, at least one; none for an empty line."""
    return F.when(line == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(line) / 4)))


def runs(rows: Column) -> Column:
    """array<struct<line, n>>: consecutive equal lines and how many there are, in time linear in the lines."""

    def build(r: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: (i == 1) | (F.get(r, i - 1) != F.get(r, i - 2)))
        return let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(r) + 1)), lambda a, b: F.struct(F.get(r, a - 1).alias("line"), (b - a).alias("n"))))

    return let(rows, lambda r: F.when(F.size(r) > 0, build(r)).otherwise(F.array().cast("array<struct<line:string,n:int>>")))


def repeated_lines(text: Column) -> Column:
    """array<struct<line, n>> of consecutive equal trimmed lines, n of at least 2; blank lines part runs."""
    return F.filter(runs(F.transform(lines(text), strip)), lambda r: (r["n"] > 1) & (r["line"] != ""))


def repeated_tokens(text: Column) -> Column:
    """Tokens that dropping the repeats would save."""
    return F.aggregate(repeated_lines(text), F.lit(0).cast("long"), lambda a, r: a + F.floor(F.octet_length(r["line"]) * (r["n"] - 1) / 4))


def _first(line: Column, forms: tuple[str, ...]) -> Column:
    return reduce(lambda rest, f: F.when(line.contains(f), f).otherwise(rest), reversed(forms), F.lit(None).cast("string"))


def trivial_conditions(text: Column) -> Column:
    """The constant condition of each line that has one."""
    return F.filter(F.transform(lines(text), lambda x: _first(strip(x), TRIVIAL_CONDITIONS)), lambda x: x.isNotNull())


def dead_code(text: Column) -> Column:
    """Trimmed comment lines that hold code."""
    holds = lambda x: reduce(lambda a, w: a | F.substring(x, 4, 1_000_000).contains(w), CODE_WORDS, F.lit(False))
    return F.filter(F.transform(lines(text), strip), lambda x: x.startswith("// ") & holds(x))


def foldable(text: Column) -> Column:
    """The first foldable expression of each line that has one."""
    return F.filter(F.transform(lines(text), lambda x: _first(x, tuple(a for a, _ in FOLDABLE))), lambda x: x.isNotNull())


def blank_lines(text: Column) -> Column:
    """Lines of spaces and tabs alone."""
    return F.filter(lines(text), lambda x: x.rlike(r"^[ \t]+\z"))


def drop_blank(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: strip(x) != ""), "\n")


def drop_repeats(text: Column) -> Column:
    """Exactly equal consecutive lines once."""
    return F.array_join(F.transform(runs(lines(text)), lambda r: r["line"]), "\n")


def drop_dead_code(text: Column) -> Column:
    """Without the lines that hold the text of any dead-code line."""
    kept = let(dead_code(text), lambda dead: F.filter(lines(text), lambda x: ~F.exists(dead, lambda d: x.contains(d))))
    return F.array_join(kept, "\n")


def fold(text: Column) -> Column:
    for a, b in FOLDABLE:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def limit_blank_runs(text: Column) -> Column:
    """Three or more blank lines in a row become two."""
    rows = F.transform(lines(text), lambda x: F.when(strip(x) == "", "").otherwise(x))
    kept = F.flatten(F.transform(runs(rows), lambda r: F.when(r["line"] == "", F.array_repeat(F.lit(""), F.least(r["n"], F.lit(2)))).otherwise(F.array_repeat(r["line"], r["n"]))))
    return F.array_join(kept, "\n")


def smoothness(before: Column, after: Column) -> Column:
    """struct<disruption, readability, compatibility, preservation> of a rewrite."""

    def mean(rows: Column) -> Column:
        return let(rows, lambda r: F.when(F.size(r) > 0, F.aggregate(r, F.lit(0.0), lambda s, x: s + F.octet_length(x)) / F.size(r)).otherwise(0.0))

    def build(a: Column, b: Column) -> Column:
        full = F.filter(b, lambda x: x != "")
        long_lines = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(mean(full) - 40, F.lit(0.0)) / 60))
        ident = F.when(mean(words(after)) < 25, 1.0).otherwise(0.5)
        most = F.greatest(F.size(a), F.size(b))
        return let(F.size(F.filter(b, lambda x: F.array_contains(a, x))), lambda common: F.struct(
            F.when(most == 0, 0.0).otherwise(1 - common / most).alias("disruption"),
            ((long_lines + ident) / 2).alias("readability"),
            F.when(F.size(F.filter(a, lambda x: x != "")) == F.size(full), 1.0).otherwise(0.8).alias("compatibility"),
            F.when(F.size(a) == 0, 1.0).otherwise(common / F.size(a)).alias("preservation"),
        ))

    return let(lines(before), lambda a: let(lines(after), lambda b: build(a, b)))


def trigrams(text: Column) -> Column:
    """Distinct runs of three bytes, as hexadecimal digits."""
    n = F.octet_length(text)
    made = let(F.hex(F.encode(text, "UTF-8")), lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(h, 2 * i - 1, F.lit(6)))))
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(made)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def head_tail(text: Column, head: int, tail: int) -> Column:
    """The first and last lines with a line that says how many are left out."""
    rows = lines(text)
    n = F.size(rows)
    gap = F.concat(F.lit("... ["), (n - head - tail).cast("string"), F.lit(" lines omitted] ..."))
    short = F.array_join(F.concat(F.slice(rows, 1, head), F.array(gap), F.slice(rows, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))), "\n")
    return F.when(n <= head + tail, text).otherwise(short)


def error_lines(text: Column, spare: int = 20) -> Column:
    """Lines with an error mark, else the first lines."""
    form = "|".join(ERROR_MARKS)
    rows = lines(text)
    hit = F.filter(rows, lambda x: x.rlike(form))
    return F.array_join(F.when(F.size(hit) > 0, hit).otherwise(F.slice(rows, 1, spare)), "\n")


def squeeze(text: Column, window: int = 0) -> Column:
    """Redraws collapsed, repeats counted, the middle elided but for error lines; a final line feed stays."""
    body = F.regexp_replace(text, r"\n\z", "")
    rows = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"^(?s:.*)\r", ""))
    told = F.flatten(F.transform(runs(rows), lambda r: F.when(r["n"] > 1, F.array(r["line"], F.concat(F.lit("[repeated "), r["n"].cast("string"), F.lit("x]")))).otherwise(F.array(r["line"]))))

    def windowed(t: Column) -> Column:
        half, n, form = max(window // 2, 1), F.size(t), "|".join(ERROR_MARKS)
        middle = F.slice(t, F.lit(half + 1), F.greatest(n - 2 * half, F.lit(0)))
        signal = F.filter(middle, lambda x: x.rlike(form))
        mark = F.concat(F.lit("[... "), F.size(middle).cast("string"), F.lit(" lines elided; "), F.size(signal).cast("string"), F.lit(" error/warning line(s) surfaced ...]"))
        return F.when(n <= window, t).otherwise(F.concat(F.slice(t, 1, half), F.array(mark), signal, F.slice(t, F.greatest(n - half + 1, F.lit(1)), F.lit(half))))

    if window:
        told = let(told, windowed)
    return F.concat(F.array_join(told, "\n"), F.when(text.endswith("\n"), "\n").otherwise(""))


def pressure(used: Column, base: float = 100_000.0) -> Column:
    return F.least(F.lit(1.0), used / base)


def ratio(press: Column) -> Column:
    return F.when(press >= 0.8, 0.3).otherwise(0.5)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a text in bits; 0 for an empty one."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda x: x != ""))

    def bits(c: Column) -> Column:
        n = F.size(c)
        total = F.aggregate(runs(c), F.lit(0.0), lambda s, r: s - r["n"] / n * F.log2(r["n"] / n))
        return F.when(n == 0, 0.0).otherwise(total)

    return let(chars, bits)


def cut_bytes(text: Column, most: Column | int) -> Column:
    """At most so many bytes, never part of a character."""
    raw, most = F.encode(text, "UTF-8"), F.lit(most) if isinstance(most, int) else most
    inner = lambda i: F.hex(F.substr(raw, i, F.lit(1))).rlike("^[89AB]")  # noqa: E731 - a byte within a character
    end = F.when(~inner(most + 1), most).when(~inner(most), most - 1).when(~inner(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).when(most <= 0, "").otherwise(F.substr(raw, F.lit(1), F.greatest(end, F.lit(0))).cast("string"))


def after_trigger(text: Column, trigger: str) -> Column:
    """What follows a trigger at the start; null without it."""
    return F.when(F.lit(bool(trigger)) & text.startswith(trigger), F.regexp_replace(F.substring(text, len(trigger) + 1, 1_000_000_000), rf"^{WHITE}", ""))


def compact_number(n: Column) -> Column:
    """A count with one decimal and a unit; halves round up."""

    def one(d: int, unit: str) -> Column:
        tenths = F.floor((n.cast("long") * 10 + d // 2) / d)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))

    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, one(1000, "k")).when(n < 1_000_000_000, one(1_000_000, "M")).otherwise(one(1_000_000_000, "G"))


def age(seconds: Column) -> Column:
    unit = lambda d, u: F.concat(F.floor(seconds / d).cast("string"), F.lit(u))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def slug(raw: Column) -> Column:
    own = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9_-]", "-"), r"^-+|-+\z", "")
    return F.when(own == "", "unknown-repo").otherwise(own)


def storage_key(name: Column, origin: Column) -> Column:
    """Slug with the first six digits of the origin's hash."""
    return F.when(origin.isNull(), slug(name)).otherwise(F.concat(slug(name), F.lit("-"), F.substring(F.sha2(origin.cast("binary"), 256), 1, 6)))


def idempotency_key(raw: Column) -> Column:
    return F.regexp_replace(F.substring(raw, 1, 128), "[^0-9A-Za-z_:.-]", "")


def hashtag(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9A-Za-z_]", "")


def plain_markdown(text: Column) -> Column:
    """Text without Markdown marks and link targets; labels, alternative texts and code stay; blank lines once."""
    out = F.regexp_replace(text, r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    out = F.regexp_replace(out, r"(?md)^[ \t]*(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d{1,9}[.)][ \t]+)", "")
    out = F.regexp_replace(out, r"(?md)^[ \t]*(?:```|~~~)[^\n]*$", "")
    out = F.regexp_replace(out, r"\*\*|__|~~|`", "")
    return strip(F.regexp_replace(out, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"))
