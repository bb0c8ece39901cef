"""Readers: repository trees, usage logs, projects, session transcripts, fetched pages."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.operators.cdc import detect_language

# What a walk never takes.
NEVER = ("*.pyc", "*.pyo", "__pycache__")
LOG = "ts long, op string, query string, results long, repo string, used_tokens long, saved_tokens long, agent_id string"


def glob_rule(pattern: str) -> str:
    """The regular expression of one line of an ignore file, for a path relative to its root."""
    body = pattern.strip("/")
    form = fnmatch.translate(body.replace("**/", "\0").replace("**", "\1")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
    form = form.replace(".*", "[^/]*").replace("\0", "(?:.*/)?").replace("\\\0", "(?:.*/)?").replace("\1", ".*").replace("\\\1", ".*")
    anchored = "/" in pattern.strip().rstrip("/")
    return ("^" if anchored else "(?:^|.*/)") + form + r"(?:/.*)?\z"


def ignored(path: Column, rules: Iterable[str]) -> Column:
    """Whether the rules leave a path out: the last rule that fits decides, `!` takes a path back; hidden names are always out."""
    out = F.lit(False)
    for line in (*NEVER, *rules):
        line = line.strip()
        if line and not line.startswith("#"):
            keep = line.startswith("!")
            out = F.when(path.rlike(glob_rule(line.lstrip("!"))), F.lit(not keep)).otherwise(out)
    return out | path.rlike(r"(?:^|/)\.[^/]")


def read_tree(spark: SparkSession, root: str, rules: Iterable[str] = (), max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """(path, lang, text, bytes, mtime, outcome) of the files below a folder.

    rules are lines of ignore files in order of growing precedence.  outcome is
    indexed, or the reason why text is null: ignored, unsupported, oversize or
    binary; the content of files that are left out by path or size is dropped in
    the scan.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    rel = F.expr(r"substring(regexp_replace(path, '^file:/*', '/'), length({}) + 2)".format("regexp_replace('" + root.rstrip("/").replace("'", "''") + "', '^file:/*', '/')"))
    del base
    own = raw.select(rel.alias("path"), F.col("length").alias("bytes"), F.expr("unix_seconds(modificationTime)").alias("mtime"), "content")
    lang = detect_language(F.col("path"))
    outcome = F.when(ignored(F.col("path"), rules), "ignored").when(lang.isNull(), "unsupported").when(F.col("bytes") > max_bytes, "oversize").when(F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) > 0, "binary").otherwise("indexed")
    out = own.select("path", lang.alias("lang"), "bytes", "mtime", outcome.alias("outcome"), "content")
    return out.select("path", "lang", F.when(F.col("outcome") == "indexed", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), "bytes", "mtime", "outcome")


def index_tree(spark: SparkSession, root: str, rules: Iterable[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, symbols, edges, counts) of a source tree; edges are by name."""
    from sparrowdex.sources.extract import extract_edges, extract_symbols

    tree = read_tree(spark, root, rules)
    texts = tree.filter("outcome = 'indexed'")
    files = texts.select("path", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "mtime")
    return files, extract_symbols(texts), extract_edges(texts), tree.groupBy("outcome").agg(F.count("*").alias("files"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a usage log in JSON lines; lines that are malformed or lack ts or op are skipped."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).filter("ts IS NOT NULL AND op IS NOT NULL")


def append_log(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").json(path)


def text_documents(files: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """(source_id, body, sha256) of files(source_id, content): without empty, blank, binary and oversize ones."""
    own = files.filter((F.octet_length("content") > 0) & (F.octet_length("content") <= max_bytes)).filter(F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) == 0)
    body = F.make_valid_utf8(F.col("content").cast("string"))
    return own.select("source_id", body.alias("body"), F.sha2(body.cast("binary"), 256).alias("sha256")).filter(F.col("body").rlike(r"[^ \t\r\n\f]"))


def mine_project(spark: SparkSession, root: str, wing: str = "proj", max_bytes: int = 1_000_000) -> DataFrame:
    """(source_id, wing, body, sha256): one document a text file; empty, binary and oversize ones are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace("file://", "") + "/", "")
    small = raw.filter(F.col("length") <= max_bytes).select(F.concat(F.lit(f"{wing}:"), name).alias("source_id"), "content")
    return text_documents(small, max_bytes).select("source_id", F.lit(wing).alias("wing"), "body", "sha256")


def _said(content: object) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(p["text"] for p in content if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str))
    return ""


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """turns (conv, turn, role, text) of JSON-lines transcripts, and (conv, skipped) with the malformed lines of each."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\z", 1).alias("conv"), F.col("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, text in zip(pdf["conv"], pdf["value"]):
                for n, line in enumerate(text.split("\n")):
                    if not line.strip():
                        continue
                    try:
                        row = json.loads(line)
                        message = row.get("message") or {}
                        role = message.get("role") or row.get("type")
                        said = _said(message.get("content"))
                    except (ValueError, AttributeError):
                        out.append((conv, n, None, None))
                        continue
                    if role in ("user", "assistant") and said:
                        out.append((conv, n, role, said))
            yield pd.DataFrame(out, columns=["conv", "turn", "role", "text"]).astype({"turn": "int32"})

    rows = lines.mapInPandas(run, "conv string, turn int, role string, text string")
    return rows.filter("role IS NOT NULL"), rows.filter("role IS NULL").groupBy("conv").agg(F.count("*").alias("skipped"))


def fetched(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(n, url, status, title, content, error) for requests(n, url) in order, from a table of pages; a page that is not there is an error."""
    last = pages.groupBy("url").agg(F.max_by(F.struct("status", "title", "content_markdown", "error"), F.struct("fetched_at", "page_id")).alias("p"))
    out = requests.join(last, "url", "left").select("n", "url", "p.status", "p.title", F.col("p.content_markdown").alias("content"), F.when(F.col("p").isNull(), "not fetched").otherwise(F.col("p.error")).alias("error"))
    return out.orderBy("n")
