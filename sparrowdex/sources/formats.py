"""Readers of data formats as symbols: Markdown headings, CSV headers, YAML keys."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 256


def markdown_headings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, kind, name) of the ATX headings: level 1 a class, 2 a type, deeper ones functions."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "row"))
    level = F.length(F.regexp_extract("row", r"^ {0,3}(#{1,6})[ \t]", 1))
    name = F.regexp_replace(F.regexp_extract("row", r"^ {0,3}#{1,6}[ \t]+([^\n]*)\z", 1), r"[ \t\r#]+\z", "")
    kind = F.when(level == 1, "class").when(level == 2, "type").otherwise("function")
    return lines.filter(F.col("row").rlike(r"^ {0,3}#{1,6}[ \t]+[^ \t\r]")).select(key, (F.col("n") + 1).alias("line"), level.alias("level"), kind.alias("kind"), name.alias("name"))


def csv_header(source: str) -> list[str]:
    """Column names of the first row, quoted as in RFC 4180, at most MAX_COLUMNS; none for an empty text."""
    row = next(csv.reader(io.StringIO(source)), [])
    return [c.strip() for c in row[:MAX_COLUMNS] if c.strip()]


_KEY = re.compile(r"^( *)(?:- )?([A-Za-z_][\w.-]*|\"[^\"]*\"|'[^']*')\s*:(?:\s|$)")


def yaml_keys(source: str, depth: int = 2) -> list[tuple[int, str, str | None]]:
    """(line, key, parent) of the mapping keys down to a depth, by indentation."""
    out, stack = [], []
    for n, line in enumerate(source.split("\n"), 1):
        m = _KEY.match(line)
        if not m or line.lstrip().startswith("#"):
            continue
        indent, key = len(m[1]), m[2].strip("\"'")
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if len(stack) < depth:
            out.append((n, key, stack[-1][1] if stack else None))
        stack.append((indent, key))
    return out


def setext_headings(source: str) -> list[tuple[int, int, str]]:
    """(line, level, name) of headings underlined with = or -."""
    rows = source.split("\n")
    return [(i, 1 if rows[i].lstrip()[0] == "=" else 2, rows[i - 1].strip()) for i in range(1, len(rows)) if re.fullmatch(r" {0,3}(=+|-+)\s*", rows[i]) and rows[i - 1].strip() and not rows[i - 1].lstrip().startswith(("#", "-", "|", ">"))]


def data_symbols(rows: DataFrame, path: str = "path", lang: str = "lang", text: str = "text") -> DataFrame:
    """(path, name, kind, parent, line) of CSV, YAML and Markdown sources; other languages give none."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, g, t in zip(pdf["path"], pdf["lang"], pdf["text"]):
                t = t or ""
                if g == "csv":
                    out += [(p, c, "var", None, 1) for c in csv_header(t)]
                elif g == "yaml":
                    out += [(p, k, "var", up, n) for n, k, up in yaml_keys(t)]
                elif g == "markdown":
                    marks = [(n, len(m[1]), m[2]) for n, x in enumerate(t.split("\n"), 1) if (m := re.match(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t\r#]*$", x)) and m[2]] + setext_headings(t)
                    out += [(p, name, ("class", "type", "function")[min(level, 3) - 1], None, n) for n, level, name in sorted(marks)]
            yield pd.DataFrame(out, columns=["path", "name", "kind", "parent", "line"]).astype({"line": "int32"})

    return rows.select(F.col(path).alias("path"), F.col(lang).alias("lang"), F.col(text).alias("text")).mapInPandas(run, "path string, name string, kind string, parent string, line int")
