"""Symbol lookup over the code index: names, callers, references, enclosing symbols, snapshots.

Inputs are the relational index: files(id, path, ...), symbols(id, file_id, name,
kind, parent_id, line_start, line_end, ...), edges(src_symbol_id, dst_symbol_id,
kind, line).  Every function is a lazy plan; small sides are left to the
optimizer, which decides by size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINEL = "sentinel"
TOP = 5
BIN = 64


def symbol_view(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path and language of their file and the name of their parent, if it exists."""
    own = symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file"), "lang"), "file_id")
    up = symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return own.join(up, "parent_id", "left")


def real(view: DataFrame) -> DataFrame:
    return view.filter(F.col("kind") != SENTINEL)


def find_symbols(view: DataFrame, names: DataFrame | Iterable[str]) -> DataFrame:
    """Real symbols of the given names, compared with case; names as values or as a table with a column name."""
    if isinstance(names, DataFrame):
        return real(view).join(names.select("name").dropna().distinct(), "name", "left_semi")
    return real(view).filter(F.col("name").isin(list(names)))


def in_files(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose file is among changed(path)."""
    return rows.join(changed.select(F.col("path").alias("file")).dropna().distinct(), "file", "left_semi")


def hits(edges: DataFrame, symbols: DataFrame, files: DataFrame, names: Iterable[str] | None, kinds: Iterable[str]) -> DataFrame:
    """(name, file, file_id, line, src_symbol_id, src_name, kind): edges into symbols of the names, sentinels included.

    Without names the callee's name of every edge is given, so that one job
    answers for all names.
    """
    own = edges.filter(F.col("kind").isin(list(kinds)))
    callee = symbols.select(F.col("id").alias("dst_symbol_id"), "name")
    if names is not None:
        callee = callee.filter(F.col("name").isin(list(names)))
    caller = symbols.select(F.col("id").alias("src_symbol_id"), F.col("name").alias("src_name"), "file_id")
    out = own.join(callee, "dst_symbol_id").join(caller, "src_symbol_id")
    return out.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id").select("name", "file", "file_id", "line", "src_symbol_id", "src_name", "kind")


def callers(edges: DataFrame, symbols: DataFrame, files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    return hits(edges, symbols, files, names, ["call"])


def references(edges: DataFrame, symbols: DataFrame, files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    return hits(edges, symbols, files, names, ["call", "ref"])


def first_hits(rows: DataFrame, limit: int) -> DataFrame:
    """The first hits in (file, line) order; a limit of 0 means all."""
    out = rows.orderBy("file", "line", "src_symbol_id")
    return out.limit(limit) if limit else out


def files_only(rows: DataFrame, limit: int = 0) -> DataFrame:
    """Distinct files in the order of their first hit, which is the order of their paths."""
    out = rows.select("file").distinct().orderBy("file")
    return out.limit(limit) if limit else out


def enclosing(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """places (file_id, line, ...) with sym_id, sym_name and sym_kind of the innermost real symbol whose lines hold the place; null without one.

    Lines are binned, so that a place meets only symbols that touch its bin; of
    equally narrow symbols the first by (line_start, id) counts.
    """
    spans = real(symbols).filter("line_end >= line_start").select(
        "file_id", F.col("id").alias("sym_id"), F.col("name").alias("sym_name"), F.col("kind").alias("sym_kind"), F.col("line_start").alias("lo"), F.col("line_end").alias("hi"),
        F.explode(F.sequence(F.floor(F.col("line_start") / BIN), F.floor(F.col("line_end") / BIN))).alias("bin"),
    )
    own = places.select("file_id", "line").distinct()
    met = own.withColumn("bin", F.floor(F.col("line") / BIN)).join(spans, ["file_id", "bin"]).filter("line BETWEEN lo AND hi")
    best = met.groupBy("file_id", "line").agg(F.min(F.struct(F.expr("hi - lo"), "lo", "sym_id", "sym_name", "sym_kind")).alias("m"))
    return places.join(best, ["file_id", "line"], "left").select(*places.columns, "m.sym_id", "m.sym_name", "m.sym_kind")


def summary(rows: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits by file, the files with most hits, the enclosing symbols with most hits."""
    by_file = rows.groupBy("file").agg(F.count("*").alias("hits"))
    top_files = by_file.orderBy(F.desc("hits"), "file").limit(TOP)
    tally = enclosing(rows, symbols).filter("sym_id IS NOT NULL").groupBy(F.col("sym_name").alias("symbol"), "file").agg(F.count("*").alias("hits"))
    return by_file, top_files, tally.orderBy(F.desc("hits"), "file", "symbol").limit(TOP)


def bare_name(name: Column) -> Column:
    """What stands behind the last double colon."""
    return F.substring_index(name, "::", -1)


def safe_identifier(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*\z")


def compact_snippet(text: Column, width: int = 80) -> Column:
    """White space collapsed, cut at a number of characters with an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n\f]+", " "), r"^ | \z", "")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)


def lines_at(texts: DataFrame, places: DataFrame, key: str, text: str) -> DataFrame:
    """places (key, line) with the text of the line, counted from 1; places outside a text fall away.

    Texts are split once for all their places, and no line but the asked ones leaves the row.
    """
    own = places.groupBy(key).agg(F.array_sort(F.collect_set("line")).alias("_at"))
    met = own.join(texts.select(key, F.split(text, "\n", -1).alias("_lines")), key)
    rows = met.select(key, "_lines", F.explode("_at").alias("line")).filter((F.col("line") >= 1) & (F.col("line") <= F.size("_lines")))
    found = rows.select(key, "line", F.get("_lines", F.col("line") - 1).alias("snippet"))
    return places.select(key, "line").join(found, [key, "line"]).select(key, "line", "snippet")


def selectors(view: DataFrame) -> DataFrame:
    """(selector, candidates, lines): FILE#Parent::name of real symbols; more than one candidate is ambiguous."""
    name = F.when(F.col("parent").isNotNull(), F.concat_ws("::", "parent", "name")).otherwise(F.col("name"))
    own = real(view).select(F.concat_ws("#", "file", name).alias("selector"), "line_start")
    return own.groupBy("selector").agg(F.count("*").alias("candidates"), F.array_join(F.sort_array(F.collect_list("line_start")), ",").alias("lines"))


def splice(text: Column, first: Column | int, last: Column | int, new: Column | str) -> Column:
    """Replace the lines first to last (from 1) by new text.

    A text with CRLF line ends gives them to the new lines too; one line feed at the
    end of the new text opens no line.  Where the lines are no span of the text, it
    stays as it is.
    """
    first, last, new = (x if isinstance(x, Column) else F.lit(x) for x in (first, last, new))
    lines = F.split(text, "\n", -1)
    put = F.transform(F.split(F.regexp_replace(new, r"\n\z", ""), "\n", -1), lambda x: F.concat(F.regexp_replace(x, r"\r\z", ""), F.when(text.contains("\r\n"), "\r").otherwise("")))
    made = F.concat(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0))), put, F.slice(lines, F.greatest(last, F.lit(0)) + 1, F.greatest(F.size(lines) - last, F.lit(0))))
    return F.when((first >= 1) & (last >= first) & (last <= F.size(lines)), F.array_join(made, "\n")).otherwise(text)


def code_chunks(symbols: DataFrame, sources: DataFrame, most: int = 6000) -> DataFrame:
    """(source_id, body): a chunk a symbol, its header, signature and lines, cut at so many characters.

    symbols(file, name, kind, signature, line_start, line_end), sources(file, text).
    Symbols whose lines are blank or outside their text give none; a file is split
    once for all its symbols.
    """
    own = symbols.groupBy("file").agg(F.collect_list(F.struct("name", "kind", "signature", "line_start", "line_end")).alias("_s"))
    rows = own.join(sources.select("file", F.transform(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")).alias("_lines")), "file")
    rows = rows.select("file", "_lines", F.inline("_s"))
    start = F.greatest(F.col("line_start"), F.lit(1))
    span = F.array_join(F.slice("_lines", start, F.greatest(F.col("line_end"), start) - start + 1), "\n")
    rows = rows.withColumn("span", span).filter(F.col("span").rlike(r"[^ \t\r\n\f]"))
    head = F.concat(F.col("file"), F.lit(":"), F.col("name"), F.lit(" ["), F.col("kind"), F.lit("]\n"), F.coalesce("signature", F.lit("")), F.lit("\n"), F.col("span"))
    return rows.select(F.concat(F.lit("code:"), F.col("file"), F.lit("#"), F.col("name"), F.lit("@"), F.col("line_start")).alias("source_id"), F.substring(head, 1, most).alias("body"))


def bundle(view: DataFrame, calls: DataFrame, refs: DataFrame, near: DataFrame, name: str, most: int = 50) -> DataFrame:
    """(part, place, name, file, line): what a change of a symbol touches, part by part.

    The symbol is the first real one of the name by id; then its callers and
    references in (file, line) order, `most` of each, the outline of its file and
    the symbols near(node, depth) that reach it, whose place is their depth.
    """
    own = real(view).filter(F.col("name") == name).orderBy("id").limit(1)
    first = own.select(F.lit("symbol").alias("part"), F.lit(1).alias("place"), "name", "file", F.col("line_start").alias("line"))

    def hits(rows: DataFrame, part: str) -> DataFrame:
        top = rows.orderBy("file", "line", "src_symbol_id").limit(most)
        return top.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy("file", "line", "src_symbol_id")).alias("place"), F.col("src_name").alias("name"), "file", "line")

    outline = real(view).join(own.select("file"), "file", "left_semi").select(F.lit("outline").alias("part"), F.lit(0).alias("place"), "name", "file", F.col("line_start").alias("line"))
    blast = near.filter("depth > 0").join(view.select(F.col("id").alias("node"), "name", "file", "line_start"), "node").select(F.lit("blast").alias("part"), F.col("depth").alias("place"), "name", "file", F.col("line_start").alias("line"))
    return first.unionByName(hits(calls, "caller")).unionByName(hits(refs, "ref")).unionByName(outline).unionByName(blast)


def fingerprint(body: Column, known: Column) -> Column:
    """'unchanged' if the SHA-256 of a body is the known one, else 'result'."""
    return F.when(F.sha2(body.cast("binary"), 256) == known, "unchanged").otherwise("result")


def diff_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, name, change): removed, added, signature_changed or body_moved between two snapshots (file, name, signature, line_start, line_end, id).

    Of several symbols of one name in a file the last by (line_start, id) counts;
    a changed signature goes before a moved body; unchanged symbols do not come out.
    """

    def last(df: DataFrame, tag: str) -> DataFrame:
        m = df.groupBy("file", "name").agg(F.max_by(F.struct("signature", "line_start", "line_end"), F.struct("line_start", "id")).alias(tag))
        return m

    both = last(before, "b").join(last(after, "a"), ["file", "name"], "full")
    change = (
        F.when(F.col("a").isNull(), "removed")
        .when(F.col("b").isNull(), "added")
        .when(~F.col("a.signature").eqNullSafe(F.col("b.signature")), "signature_changed")
        .when(~F.col("a.line_start").eqNullSafe(F.col("b.line_start")) | ~F.col("a.line_end").eqNullSafe(F.col("b.line_end")), "body_moved")
    )
    return both.select("file", "name", change.alias("change")).filter("change IS NOT NULL")


def broken_callers(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct files with a call of a removed name."""
    gone = changes.filter("change = 'removed'").select("name").distinct()
    return calls.join(gone, "name", "left_semi").select("file").distinct()


def by_repo(rows: DataFrame, column: str = "file") -> DataFrame:
    """Add repo, the first part of the path."""
    return rows.withColumn("repo", F.substring_index(column, "/", 1))


def hot_symbols(edges: DataFrame, view: DataFrame, limit: int, kinds: Iterable[str] | None = None, include_sentinel: bool = True) -> DataFrame:
    """(id, name, kind, file, in_degree): most edges in, ties by id; the count goes before the join, so the join is small."""
    own = edges if kinds is None else edges.filter(F.col("kind").isin(list(kinds)))
    deg = own.groupBy(F.col("dst_symbol_id").alias("id")).agg(F.count("*").alias("in_degree"))
    rows = view if include_sentinel else real(view)
    return deg.join(rows.select("id", "name", "kind", "file"), "id").select("id", "name", "kind", "file", "in_degree").orderBy(F.desc("in_degree"), "id").limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order.

    A hot key is dealt to 16 tasks first: the first of each part, then the first of
    these.  Of rows alike in keys and order one comes out.
    """
    rank = F.row_number()
    part = rows.withColumn("_p", F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
    part = part.withColumn("_n", rank.over(Window.partitionBy(*keys, "_p").orderBy(*order))).filter("_n = 1")
    return part.withColumn("_n", rank.over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n", "_p")
