"""Call-graph operators: level-synchronous walks, components, shortest paths, impact.

Walks keep only thin (node, depth) tables, cut lineage at every level through the
shared folder and visit each node once, at its least depth.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.runtime import cut


def call_graph(edges: DataFrame, kinds: Iterable[str] | None = ("call",)) -> DataFrame:
    """Distinct (src, dst) pairs of the edge kinds; all kinds with None; self loops stay."""
    own = edges if kinds is None else edges.filter(F.col("kind").isin(list(kinds)))
    return own.select(F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst")).dropna().distinct()


def walk(pairs: DataFrame, seeds: DataFrame, max_depth: int, incoming: bool = False) -> DataFrame:
    """(node, depth): nodes within max_depth steps of the seeds(node), seeds at depth 0.

    Of several seeds the nearest counts.  Null seeds count for nothing.
    """
    step = pairs.selectExpr("dst AS at", "src AS node") if incoming else pairs.selectExpr("src AS at", "dst AS node")
    front = cut(seeds.select(F.col("node").cast("long")).dropna().distinct())
    levels = [front.withColumn("depth", F.lit(0))]
    seen = front
    for depth in range(1, max_depth + 1):
        new = step.join(front.withColumnRenamed("node", "at"), "at").select("node").distinct().join(seen, "node", "left_anti")
        front = cut(new)
        if front.isEmpty():
            break
        levels.append(front.withColumn("depth", F.lit(depth)))
        seen = cut(seen.union(front)) if depth % 4 == 0 else seen.union(front)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def reached(pairs: DataFrame, seeds: DataFrame, max_depth: int, incoming: bool = False) -> DataFrame:
    """walk() without the seeds themselves."""
    return walk(pairs, seeds, max_depth, incoming).filter("depth > 0")


def blast_radius(edges: DataFrame, view: DataFrame, roots: DataFrame, max_depth: int, kinds: Iterable[str] | None = None) -> DataFrame:
    """(id, name, kind, file, depth) of symbols that reach a root within max_depth edges of the kinds; roots excluded."""
    near = reached(call_graph(edges, kinds), roots, max_depth, incoming=True)
    return near.withColumnRenamed("node", "id").join(view.select("id", "name", "kind", "file"), "id").select("id", "name", "kind", "file", "depth")


def orphans(pairs: DataFrame) -> DataFrame:
    """(node) with a pair out and none in."""
    return pairs.select(F.col("src").alias("node")).distinct().join(pairs.select(F.col("dst").alias("node")), "node", "left_anti")


def _trim(pairs: DataFrame, rounds: int) -> DataFrame:
    """Drop pairs whose ends can be on no cycle: nodes without a way in or out, a few layers a round."""
    before = None
    for _ in range(rounds):
        for _ in range(3):
            pairs = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        pairs = cut(pairs)
        n = pairs.count()
        if n == before or not n:
            break
        before = n
    return pairs


def _spread(pairs: DataFrame, labels: DataFrame, steps: int = 4) -> DataFrame:
    """Each node's largest label among all nodes that reach it, itself included; several steps a round."""
    labels = labels.withColumn("was", F.col("label"))
    while True:
        new = labels.select("node", F.col("label").alias("was"), "label")
        for _ in range(steps):
            came = pairs.join(new.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("more"))
            new = new.join(came, "node", "left").select("node", "was", F.greatest("label", F.coalesce("more", "label")).alias("label"))
        new = cut(new, labels)
        if new.filter("label > was").isEmpty():
            return new.select("node", "label")
        labels = new


def cycles(pairs: DataFrame, trim_rounds: int = 2) -> DataFrame:
    """(node, component): strongly connected components of at least two nodes, named by their smallest node.

    Colouring: labels spread forwards; a node that keeps its own label is a root,
    and what reaches the root backwards within its colour is its component.
    Components found leave the graph and the rest is coloured again.  A self loop
    alone is no cycle.
    """
    rest = _trim(pairs.filter("src <> dst"), trim_rounds)
    found = None
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = _spread(rest, nodes.withColumn("label", F.col("node")))
        c = colour.withColumnRenamed("label", "colour")
        inner = rest.join(c.selectExpr("node AS src", "colour AS cs"), "src").join(c.selectExpr("node AS dst", "colour AS cd"), "dst").filter("cs = cd")
        inner = cut(inner.select("src", "dst", F.col("cs").alias("colour")))
        member = cut(c.filter("node = colour"))
        while True:
            grown = member
            for _ in range(4):
                back = inner.join(grown.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour")
                grown = grown.unionByName(back).distinct()
            before = member.count()
            member = cut(grown, member)
            if member.count() == before:
                break
        size = member.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).filter("n > 1")
        part = cut(member.join(size, "colour").select("node", "component"))
        found = part if found is None else found.union(part)
        gone = member.select("node")
        rest = rest.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        rest = _trim(rest, trim_rounds)
    return found if found is not None else pairs.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)


def why(edges: DataFrame, src: int, dst: int, max_depth: int) -> DataFrame:
    """(hop, src, dst, kind, line): a shortest directed path by edges of any kind; no rows without one.

    Of equally short paths the one whose nodes are smallest from the start counts,
    of parallel edges the first by (kind, line).  src = dst gives no edges.
    """
    pairs = call_graph(edges, None)
    spark = edges.sparkSession
    end = spark.createDataFrame([(dst,)], "node long")
    back = walk(pairs, end, max_depth, incoming=True).withColumnRenamed("depth", "left")
    back = cut(back)
    at = back.filter(F.col("node") == src).first()
    hops = []
    if at is not None:  # one action a hop, each over the edges of one node
        node = at["node"]
        for hop in range(1, at["left"] + 1):
            step = pairs.filter(F.col("src") == node).join(back.filter(F.col("left") == at["left"] - hop).selectExpr("node AS dst"), "dst").agg(F.min("dst").alias("dst")).first()
            hops.append((hop, node, step["dst"]))
            node = step["dst"]
    path = spark.createDataFrame(hops, "hop int, src long, dst long")
    chosen = edges.select(F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst"), "kind", "line").join(path, ["src", "dst"])
    return chosen.groupBy("hop", "src", "dst").agg(F.min(F.struct("kind", "line")).alias("e")).select("hop", "src", "dst", "e.kind", "e.line")


def file_pairs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src_file, dst_file, weight): edges between symbols of different files."""
    own = edges.join(symbols.selectExpr("id AS src_symbol_id", "file_id AS src_file"), "src_symbol_id").join(symbols.selectExpr("id AS dst_symbol_id", "file_id AS dst_file"), "dst_symbol_id")
    return own.filter("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count("*").alias("weight"))


def importers(edges: DataFrame, symbols: DataFrame, files: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """(file, edges, depth): files that lead into the targets(file_id), in waves.

    A file comes out in the first wave that has an edge of it into the files
    reached so far, with the number of such edges.
    """
    weighted = cut(file_pairs(edges, symbols))
    seen = cut(targets.select("file_id").dropna().distinct())
    waves = None
    for depth in range(1, max_depth + 1):
        into = weighted.join(seen.select(F.col("file_id").alias("dst_file")), "dst_file", "left_semi").join(seen.select(F.col("file_id").alias("src_file")), "src_file", "left_anti")
        wave = cut(into.groupBy(F.col("src_file").alias("file_id")).agg(F.sum("weight").alias("edges")).withColumn("depth", F.lit(depth)))
        if wave.isEmpty():
            break
        waves = wave if waves is None else waves.union(wave)
        seen = cut(seen.union(wave.select("file_id")))
    if waves is None:
        waves = seen.select("file_id", F.lit(0).cast("long").alias("edges"), F.lit(0).alias("depth")).limit(0)
    return waves.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id").select("file", "edges", "depth")


# Where tests live and how they are called.
TEST_FILES = r"(?:^|/)(?:tests?)/|(?:^|/)(?:[^/]*_test\.(?:rs|go|py)|test_[^/]*\.py|[^/]*\.test\.(?:ts|tsx|js|jsx)|[^/]*\.spec\.(?:ts|js))\z"
TEST_PARENTS = r"^(?:tests?|.*_tests?)\z"


def is_test(kind: Column, file: Column, name: Column, parent: Column) -> Column:
    """Whether a symbol looks like a test: a function or method of a test file, name or module."""
    named = name.startswith("test_") | (file.endswith("_test.go") & (name.startswith("Test") | name.startswith("Benchmark")))
    return kind.isin("function", "method") & (file.rlike(TEST_FILES) | named | F.coalesce(F.lower(parent).rlike(TEST_PARENTS), F.lit(False)))


def affected(edges: DataFrame, view: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """(id, name, file, line_start, depth): tests that reach a changed(node) symbol by calls or references, changed tests at depth 0.

    One walk from all changed symbols together gives each test its least depth.
    """
    near = walk(call_graph(edges, ("call", "ref")), changed, depth, incoming=True).withColumnRenamed("node", "id")
    tests = view.filter(is_test(F.col("kind"), F.col("file"), F.col("name"), F.col("parent")))
    return near.join(tests.select("id", "name", "file", "line_start"), "id").select("id", "name", "file", "line_start", "depth")


# Manifest files by runner, in order of precedence, and the commands.
RUNNERS = (("cargo", r"(?:^|/)Cargo\.toml\z"), ("go", r"(?:^|/)go\.mod\z"), ("pytest", r"(?:^|/)(?:pyproject\.toml|pytest\.ini|setup\.cfg|tox\.ini)\z"), ("npm", r"(?:^|/)package\.json\z"))
COMMANDS = {"cargo": ("cargo test -- ", " ", ""), "go": ("go test ./... -run '^(", "|", ")$'"), "pytest": ('pytest -k "', " or ", '"'), "npm": ('npm test -- -t "', "|", '"')}


def runner_of(path: Column) -> Column:
    """The runner a manifest file stands for; null for other files."""
    out = F.lit(None).cast("string")
    for name, form in reversed(RUNNERS):
        out = F.when(path.rlike(form), name).otherwise(out)
    return out


def runners(files: DataFrame, place: Column) -> DataFrame:
    """(place, runner): the runner of each place with a manifest among its files(path), the first in precedence."""
    rank = F.array_position(F.array(*[F.lit(n) for n, _ in RUNNERS]), runner_of(F.col("path")))
    own = files.select(place.alias("place"), rank.alias("r")).filter("r IS NOT NULL").groupBy("place").agg(F.min("r").alias("r"))
    return own.select("place", F.element_at(F.array(*[F.lit(n) for n, _ in RUNNERS]), F.col("r").cast("int")).alias("runner"))


def command_for(runner: Column, names: Column) -> Column:
    """The command that runs the named tests, names sorted and once each; null without a runner or a test."""
    own = F.array_sort(F.array_distinct(names))
    out = F.lit(None).cast("string")
    for name, (head, gap, tail) in COMMANDS.items():
        out = F.when((runner == name) & (F.size(own) > 0), F.concat(F.lit(head), F.array_join(own, gap), F.lit(tail))).otherwise(out)
    return out


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int, same_host: bool = True, max_pages: int | None = None) -> DataFrame:
    """(seed, url, depth): pages a crawl from each seed(url) takes, shallowest first.

    pages(url), links(url, target); a link is followed while the depth is less
    than max_depth, to the seed's host only with same_host; a target that is no
    page counts as a fetched page with an error, as it uses up the budget.  With
    max_pages the first pages by (depth, url) of each seed count.
    """
    host = lambda c: F.regexp_extract(c, r"://([^/]+)", 1)
    front = cut(seeds.select(F.col("url").alias("seed"), "url").dropna().distinct().withColumn("depth", F.lit(0)))
    out = seen = front
    for depth in range(1, max_depth + 1):
        new = front.join(pages.select("url").distinct(), "url", "left_semi").join(links, "url").select("seed", F.col("target").alias("url")).distinct()
        if same_host:
            new = new.filter(host(F.col("seed")) == host(F.col("url")))
        front = cut(new.join(seen.select("seed", "url"), ["seed", "url"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        out = seen = seen.unionByName(front)
    if max_pages is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "url"))).filter(F.col("_n") <= max_pages).drop("_n")
    return out


def claim(frontier: DataFrame, limit: int) -> DataFrame:
    """The next pages to fetch: queued rows (url, depth, seq, state) by depth and order of arrival, now in flight."""
    return frontier.filter("state = 'queued'").orderBy("depth", "seq").limit(limit).withColumn("state", F.lit("inflight"))


def reopen(frontier: DataFrame) -> DataFrame:
    """A frontier after a restart: what was in flight is queued again."""
    return frontier.withColumn("state", F.when(F.col("state") == "inflight", "queued").otherwise(F.col("state")))
