"""Source text to symbols and edges.

Python sources are read by the standard library's parser; other languages by
scanners of definitions at line starts and of calls by name, which approximate a
grammar: strings and comments are blanked first, a definition reaches to the end
of its braces (or, without braces, of its indentation).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 2 * 1024 * 1024

# Definitions by language as (form, kind); the group is the name.
DEFINITIONS = {
    "rust": ((r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", "function"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(\w+)", "struct"), (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "trait"), (r"(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:", "const"), (r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "module"), (r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", "impl")),
    "go": ((r"func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"type\s+(\w+)\s+struct", "struct"), (r"type\s+(\w+)\s+interface", "trait"), (r"type\s+(\w+)", "type"), (r"const\s+(\w+)", "const"), (r"var\s+(\w+)", "var")),
    "typescript": ((r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"(?:export\s+)?interface\s+(\w+)", "trait"), (r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum"), (r"(?:export\s+)?type\s+(\w+)", "type"), (r"(?:export\s+)?(?:const|let|var)\s+(\w+)", "const")),
    "java": ((r"(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|record)\s+(\w+)", "class"), (r"(?:(?:public|protected|private|static)\s+)*interface\s+(\w+)", "trait"), (r"(?:(?:public|protected|private|static)\s+)*enum\s+(\w+)", "enum"), (r"(?:(?:public|protected|private|static|final|abstract|synchronized|native)\s+)+(?:<[^>]*>\s*)?[\w<>\[\], ?.]+\s+(\w+)\s*\(", "method")),
    "ruby": ((r"def\s+(?:self\.)?(\w+[?!=]?)", "method"), (r"class\s+(\w+)", "class"), (r"module\s+(\w+)", "module")),
    "swift": ((r"(?:\w+\s+)*func\s+(\w+)", "function"), (r"(?:\w+\s+)*class\s+(\w+)", "class"), (r"(?:\w+\s+)*struct\s+(\w+)", "struct"), (r"(?:\w+\s+)*enum\s+(\w+)", "enum"), (r"(?:\w+\s+)*protocol\s+(\w+)", "trait")),
    "bash": ((r"function\s+([\w-]+)", "function"), (r"([\w-]+)\s*\(\)\s*\{", "function")),
    "c": ((r"(?:typedef\s+)?struct\s+(\w+)\s*\{", "struct"), (r"enum\s+(\w+)\s*\{", "enum"), (r"(?:static\s+|inline\s+|extern\s+|const\s+|unsigned\s+)*\w[\w ]*[\s*]+(\w+)\s*\([^;]*$", "function")),
    "zig": ((r"(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+(\w+)", "function"), (r"(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?struct", "struct"), (r"(?:pub\s+)?const\s+(\w+)", "const")),
}
for _same, _as in (("tsx", "typescript"), ("javascript", "typescript")):
    DEFINITIONS[_same] = DEFINITIONS[_as]
_FORMS = {lang: [(re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*" + f), k) for f, k in forms] for lang, forms in DEFINITIONS.items()}
_HOLDERS = {"class", "struct", "trait", "impl", "enum"}
_CALLABLE = {"function", "method"}
# Words before a parenthesis that are no calls.
_NO_CALL = frozenset("if for while switch match return catch fn func function def class elif else in and or not await new sizeof typeof".split())
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*(?:::<[^>]*>)?\(")
_HASH_COMMENT = {"python", "ruby", "bash"}


def blanked(source: str, lang: str) -> str:
    """The source with the insides of strings and comments replaced by blanks, line ends kept."""
    comment = r"#[^\n]*" if lang in _HASH_COMMENT else r"//[^\n]*|/\*.*?\*/"
    form = re.compile(rf'"(?:\\.|[^"\\\n])*"|{comment}' + (r"|'(?:\\.|[^'\\\n])*'" if lang not in ("rust",) else ""), re.S)
    return form.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def signature(text: str) -> str:
    """A definition's text up to its body on one line, without an opening brace or equals sign at the end."""
    return re.sub(r"\s+", " ", text).strip().rstrip("{=").strip()


def name_visibility(lang: Column, name: Column) -> Column:
    """Visibility that follows from the name: capitals in Go, underscores in Python; null for other languages."""
    dunder = name.startswith("__") & name.endswith("__") & (F.length(name) >= 4)
    return F.when(lang == "go", F.when(name.rlike("^[A-Z]"), "pub").otherwise("priv")).when(lang == "python", F.when(name.startswith("_") & ~dunder, "priv").otherwise("pub"))


def declared_visibility(lang: Column, name: Column, text: Column) -> Column:
    """Visibility of a definition from its language, name and text, as visibility() gives it row by row."""
    text = F.coalesce(F.regexp_replace(text, r"^[ \t\r\n\f]+", ""), F.lit(""))
    word = lambda w, within: within.rlike(rf"\b{w}\b")
    head, front = F.substring_index(text, "(", 1), F.substring_index(text, "func", 1)
    own = F.regexp_replace(F.regexp_extract(text, r"^pub(?:\s*\([^)]*\))?", 0), r"\s", "")
    java = F.when(word("private", head), "priv").when(word("protected", head), "protected").when(word("public", head), "pub").otherwise("pkg")
    swift = F.lit(None).cast("string")
    for token in ("private", "fileprivate", "internal", "open", "public"):
        swift = F.when(word(token, front), token).otherwise(swift)
    return (
        F.when(lang.isin("go", "python"), name_visibility(lang, name))
        .when(lang == "rust", F.when(own != "", own))
        .when(lang.isin("typescript", "tsx"), F.when(text.startswith("export"), "pub"))
        .when(lang == "java", java)
        .when(lang == "swift", swift)
        .when(lang == "c", F.when(word("static", text), "priv"))
        .when(lang == "zig", F.when(text.startswith("pub"), "pub").otherwise("priv"))
    )


def compact_signature(text: Column) -> Column:
    flat = F.regexp_replace(text, r"[ \t\r\n\f]+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"^ | \z", ""), r"[ {=]+\z", "")


def visibility(lang: str, line: str, name: str) -> str | None:
    line = line.strip()
    if lang == "rust":
        m = re.match(r"pub(?:\s*\([^)]*\))?", line)
        return re.sub(r"\s", "", m[0]) if m else None
    if lang == "go":
        return "pub" if name[:1].isupper() and name[:1].isascii() else "priv"
    if lang == "python":
        return "priv" if name.startswith("_") and not (name.startswith("__") and name.endswith("__") and len(name) >= 4) else "pub"
    if lang in ("typescript", "tsx"):
        return "pub" if line.startswith("export") else None
    if lang == "java":
        return next((v for k, v in (("private", "priv"), ("protected", "protected"), ("public", "pub")) if re.search(rf"\b{k}\b", line.split("(")[0])), "pkg")
    if lang == "swift":
        return next((k for k in ("public", "open", "internal", "fileprivate", "private") if re.search(rf"\b{k}\b", line.split("func")[0])), None)
    if lang == "c":
        return "priv" if re.search(r"\bstatic\b", line) else None
    if lang == "zig":
        return "pub" if line.startswith("pub") else "priv"
    return None


def _python(source: str) -> tuple[list[dict], list[dict]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    rows = source.split("\n")
    symbols, edges = [], []

    def walk(node: ast.AST, parent: str | None, caller: str | None, holder: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if holder else "function"
                body = child.body[0].lineno if child.body else child.lineno
                head = "\n".join(rows[child.lineno - 1 : max(child.lineno, body - 1)])
                symbols.append({"name": child.name, "kind": kind, "parent": parent, "line_start": child.lineno, "line_end": child.end_lineno, "signature": signature(head).rstrip(":"), "visibility": visibility("python", "", child.name)})
                walk(child, child.name, caller if kind == "class" else child.name, kind == "class")
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        edges.append({"src_name": caller, "dst_name": name, "kind": "call", "line": child.lineno})
                walk(child, parent, caller, False)

    walk(tree, None, None, False)
    return symbols, edges


def _scanned(source: str, lang: str) -> tuple[list[dict], list[dict]]:
    clean = blanked(source, lang).split("\n")
    rows = source.split("\n")
    symbols: list[dict] = []
    for n, line in enumerate(clean):
        for form, kind in _FORMS[lang]:
            m = form.match(line)
            if not m or m[1] in _NO_CALL:
                continue
            depth, opened, end = 0, False, n
            for j in range(n, len(clean)):
                depth += clean[j].count("{") - clean[j].count("}")
                opened |= "{" in clean[j]
                end = j
                if (opened and depth <= 0) or (not opened and (clean[j].rstrip().endswith(";") or lang == "ruby")):
                    break
            if lang == "ruby":
                pad = len(line) - len(line.lstrip())
                end = next((j for j in range(n + 1, len(clean)) if clean[j].strip() == "end" and len(clean[j]) - len(clean[j].lstrip()) <= pad), n)
            elif not opened and end > n and not clean[end].rstrip().endswith(";"):
                end = n
            symbols.append({"name": m[1], "kind": kind, "parent": None, "line_start": n + 1, "line_end": end + 1, "signature": signature(rows[n]), "visibility": visibility(lang, rows[n], m[1])})
            break
    for s in symbols:
        around = [p for p in symbols if p is not s and p["line_start"] <= s["line_start"] and p["line_end"] >= s["line_end"]]
        if around:
            up = min(around, key=lambda p: (p["line_end"] - p["line_start"], -p["line_start"]))
            s["parent"] = up["name"]
            if s["kind"] == "function" and up["kind"] in _HOLDERS:
                s["kind"] = "method"
    edges = []
    callables = [s for s in symbols if s["kind"] in _CALLABLE]
    starts = {(s["line_start"], s["name"]) for s in symbols}
    for n, line in enumerate(clean, 1):
        for m in _CALL.finditer(line):
            if m[1] in _NO_CALL or (n, m[1]) in starts:
                continue
            around = [s for s in callables if s["line_start"] <= n <= s["line_end"]]
            src = min(around, key=lambda p: p["line_end"] - p["line_start"])["name"] if around else None
            edges.append({"src_name": src, "dst_name": m[1], "kind": "call", "line": n})
        if lang == "rust":
            for m in re.finditer(r"(?<![\w:])([A-Z]\w*)\b(?!\s*[({!])", line):
                if (n, m[1]) not in starts:
                    around = [s for s in callables if s["line_start"] <= n <= s["line_end"]]
                    edges.append({"src_name": min(around, key=lambda p: p["line_end"] - p["line_start"])["name"] if around else None, "dst_name": m[1], "kind": "ref", "line": n})
    return [s for s in symbols if s["kind"] != "impl"], edges


def extract(source: str, lang: str | None) -> tuple[list[dict], list[dict]]:
    """Symbols and edges of a source text; none for other languages and oversize texts."""
    if not source or lang is None or len(source) > MAX_BYTES or 4 * len(source) > MAX_BYTES and len(source.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return [], []
    if lang == "python":
        return _python(source)
    return _scanned(source, lang) if lang in _FORMS else ([], [])


_SYMBOLS = "path string, name string, kind string, parent string, line_start int, line_end int, signature string, visibility string"
_EDGES = "path string, src_name string, dst_name string, kind string, line int"


def extract_symbols(texts: DataFrame) -> DataFrame:
    """Symbols of texts(path, lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [{"path": p} | s for p, g, t in zip(pdf["path"], pdf["lang"], pdf["text"]) for s in extract(t, g)[0]]
            yield pd.DataFrame(out, columns=["path", "name", "kind", "parent", "line_start", "line_end", "signature", "visibility"])

    return texts.select("path", "lang", "text").mapInPandas(run, _SYMBOLS)


def extract_edges(texts: DataFrame) -> DataFrame:
    """Call and reference edges by name of texts(path, lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [{"path": p} | e for p, g, t in zip(pdf["path"], pdf["lang"], pdf["text"]) for e in extract(t, g)[1]]
            yield pd.DataFrame(out, columns=["path", "src_name", "dst_name", "kind", "line"])

    return texts.select("path", "lang", "text").mapInPandas(run, _EDGES)


def scan_name(texts: DataFrame, key: str, text: str, name: str, calls: bool = False) -> DataFrame:
    """(key, line, snippet): lines that hold an identifier, or a call of it; texts without the word are skipped before they are split."""
    if not re.fullmatch(r"[^\W\d]\w*", name):
        return texts.select(key, F.lit(0).alias("line"), F.lit("").alias("snippet")).limit(0)
    form = rf"(?:^|[^\w$]){name}[ \t]*\(" if calls else rf"(?:^|[^\w$]){name}(?:[^\w$]|\z)"
    lines = texts.filter(F.col(text).contains(name)).select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "snippet"))
    return lines.filter(F.col("snippet").rlike(form)).select(key, (F.col("n") + 1).alias("line"), "snippet")


_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^#\n;]+)", re.M)
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^#\n;]+))", re.M)
_TS_IMPORT = re.compile(r"^[ \t]*import[ \t]+(?:type[ \t]+)?([^'\"]+?)[ \t]+from[ \t]+['\"]([^'\"]+)['\"]", re.M)
_RS_USE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);", re.M)


def _use_tree(tree: str, before: str = "") -> Iterator[tuple[str, str]]:
    """(local name, path) of the leaves of a Rust use tree; globs bind no name."""
    tree = tree.strip()
    head, brace, rest = tree.partition("{")
    if brace:
        depth, part = 0, ""
        for c in rest.rsplit("}", 1)[0] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if part.strip():
                    yield from _use_tree(part, before + head.strip())
                part = ""
            else:
                part += c
        return
    path, _, alias = (x.strip() for x in (before + tree).partition(" as "))
    if path.endswith("::self"):
        path = path[: -len("::self")]
    name = alias or path.rsplit("::", 1)[-1]
    if name not in ("*", "_", ""):
        yield name, path


def harvest_imports(source: str, lang: str | None) -> list[tuple[str, str]]:
    """(local name, qualified name) of what a source imports; qualified names join their parts with `::`."""
    out: list[tuple[str, str]] = []
    text = source or ""
    if lang == "python":
        for m in _PY_IMPORT.finditer(text):
            for part in m[1].split(","):
                path, _, alias = (x.strip() for x in part.partition(" as "))
                if path:
                    out.append((alias or path.split(".")[0], (path if alias else path.split(".")[0]).replace(".", "::")))
        for m in _PY_FROM.finditer(text):
            for part in (m[2] or m[3] or "").split(","):
                name, _, alias = (x.strip() for x in part.partition(" as "))
                if name and name != "*":
                    out.append((alias or name, "::".join([*[x for x in m[1].split(".") if x], name])))
    elif lang in ("typescript", "tsx", "javascript"):
        for m in _TS_IMPORT.finditer(text):
            module = re.sub(r"\.(?:tsx?|jsx?)$", "", m[2])
            module = "::".join(x for x in module.split("/") if x not in (".", "..", ""))
            named = re.search(r"\{([^}]*)\}", m[1])
            for part in (named[1].split(",") if named else []):
                name, _, alias = (x.strip() for x in part.replace("type ", "").partition(" as "))
                if name:
                    out.append((alias or name, f"{module}::{name}"))
            for part in re.sub(r"\{[^}]*\}", "", m[1]).split(","):
                part = part.strip()
                if part.startswith("*"):
                    out.append((part.partition(" as ")[2].strip(), module))
                elif part:
                    out.append((part, f"{module}::default"))
    elif lang == "rust":
        for m in _RS_USE.finditer(text):
            out += list(_use_tree(re.sub(r"\s+", " ", m[1])))
    return [(a, b) for a, b in out if a]


def extract_imports(texts: DataFrame) -> DataFrame:
    """(path, local, qualified) of the imports of texts(path, lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, *x) for p, g, t in zip(pdf["path"], pdf["lang"], pdf["text"]) for x in harvest_imports(t, g)]
            yield pd.DataFrame(out, columns=["path", "local", "qualified"])

    return texts.select("path", "lang", "text").mapInPandas(run, "path string, local string, qualified string")


def resolve_scoped(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (file_id, name) with target: what a name means in its file.

    In this order: the file's own definition; the symbol of the qualified name that
    the file imports under the name; the first symbol of that name if it is imported
    at all; the one symbol of that name anywhere.  Else null.  imports: (file_id,
    local, qualified); of several imports of a name the smallest known target counts.
    """
    known = symbols.filter("kind <> 'sentinel'")
    local = known.groupBy("file_id", "name").agg(F.min("id").alias("near"))
    by_path = known.filter("qualified IS NOT NULL").groupBy("qualified").agg(F.min("id").alias("far"))
    any_of = known.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    alias = imports.join(by_path, "qualified", "left").groupBy("file_id", F.col("local").alias("name")).agg(F.min("far").alias("far"), F.lit(True).alias("imported"))
    out = refs.join(local, ["file_id", "name"], "left").join(alias, ["file_id", "name"], "left").join(any_of, "name", "left")
    return out.select(*refs.columns, F.coalesce("near", "far", F.when(F.col("imported") | (F.col("n") == 1), F.col("first"))).alias("target"))
