"""Parent links to full hierarchies, by heavy-path decomposition.

All steps take a number of rounds logarithmic in the depth (pointer doubling) or
in the number of rows (light edges on a path), whatever the shape: one parent
may hold a third of all rows, and one chain may be as long as the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.runtime import cut, dropped, guarded_broadcast, partitions_for


#: Rows still climbing, counted, that travel to the ended ones instead of meeting them in a shuffle.
SMALL = 200_000
#: Rows a round may leave behind in the shared folder until the end, for one write less.
KEPT = 1_000_000


def clean_links(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent): one row an id, parent null where it is null or no id of the table.

    Rows without an id are left out; of a repeated id the smallest parent counts.
    """
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
    own = own.filter("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"))
    child = own.filter("parent IS NOT NULL")
    linked = child.join(own.select(F.col("id").alias("known")), F.col("parent") == F.col("known"), "left")
    roots = own.filter("parent IS NULL").select("id", F.lit(None).cast("long").alias("parent"))
    return roots.union(linked.select("id", F.col("known").alias("parent")))


def climb(links: DataFrame, weigh: bool = False, sizes: bool = False, cycles: bool = True) -> tuple[DataFrame, DataFrame]:
    """Follow parent links to their ends, all rows at once, doubling the stride.

    links: (id, parent[, weight]).  Gives (id, parent, top, hops[, total][, size])
    of the rows whose chain ends, and (id, parent, cycle_id) of the rows whose
    chain never ends.  total sums the weights from a row up to its top, size
    counts the rows of its subtree.  A round rewrites the rows still climbing
    alone; those that have ended are kept apart and only read.  While any chain
    that ends is still longer than the stride, the next round ends at least one
    row; a round that ends none leaves only rows that lead into closed chains.
    """
    weight = F.col("weight") if weigh else F.lit(0)
    own = links.select("id", "parent", weight.cast("long").alias("total"), F.lit(1).cast("long").alias("size"))
    own = cut(own)
    done = own.filter("parent IS NULL").select("id", "parent", F.col("id").alias("top"), F.lit(0).cast("long").alias("hops"), "total", "size")
    act = own.filter("parent IS NOT NULL").select("id", "parent", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("hops"), F.col("id").alias("low"), "total", "size")
    late, left = None, act.count()
    while left:
        moved = act
        if sizes:  # a subtree that reaches a full stride down counts for the row above; for rows that have ended, in the end
            gain = act.groupBy("anc").agg(F.sum("size").alias("more")).join(guarded_broadcast(act, left, SMALL).select(F.col("id").alias("anc"), F.lit(True).alias("climbs")), "anc", "left")
            gain = cut(gain.withColumnRenamed("anc", "id"))
            part = gain.filter("climbs IS NULL").select("id", "more")
            late = part if late is None else late.unionByName(part)
            moved = act.join(gain.filter("climbs").select("id", "more"), "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        on = [F.lit(None).cast("long").alias(x) for x in ("anc2", "low2", "top2")]
        seen = act.selectExpr("id AS anc", "hops AS hops2", "total AS total2", "anc AS anc2", "low AS low2", "CAST(NULL AS BIGINT) AS top2")
        seen = seen.unionByName(done.select(F.col("id").alias("anc"), F.col("hops").alias("hops2"), F.col("total").alias("total2"), on[0], on[1], F.col("top").alias("top2")))
        step = cut(seen.join(guarded_broadcast(moved, left, SMALL), "anc").select(
            "id", "parent", F.col("anc2").alias("anc"), F.col("top2").alias("top"), F.least("low", "low2").alias("low"),
            (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("total") + F.col("total2")).alias("total"), "size",
        ))
        new, over = step.filter("anc IS NOT NULL").drop("top"), step.filter("anc IS NULL").select("id", "parent", "top", "hops", "total", "size")
        now = new.count()
        if now > KEPT and 2 * now > left:  # many rows, of which few have ended: part them, so that what is no longer read can go
            new, over = cut(new), cut(over)
            dropped(step)
            dropped(act)
        done, act = done.unionByName(over), new
        if now == left:
            break
        left = now
    if late is not None:
        done = done.join(late.groupBy("id").agg(F.sum("more").alias("more")), "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
    kept = ["id", "parent", "top", "hops"] + ["total"] * weigh + ["size"] * sizes
    return done.select(*kept), _cycles(act.select("id", "parent", "anc", "low"), left if cycles else 0)


def _cycles(open_rows: DataFrame, count: int) -> DataFrame:
    """(id, parent, cycle_id) of rows that lead into closed chains.

    Doubling goes on over these rows alone until the smallest id seen from the
    ancestor is the same for every row and its parent, which holds exactly when
    it is the smallest id of the closed chain.
    """
    if not count:
        return open_rows.select("id", "parent", F.col("low").alias("cycle_id")).limit(0)
    cur, old = open_rows, None
    while True:
        seen = cur.selectExpr("id AS anc", "anc AS anc2", "low AS low2")
        cur = old = cut(cur.join(seen, "anc").select("id", "parent", F.col("low2").alias("seen"), F.col("anc2").alias("anc"), F.least("low", "low2").alias("low")), old)
        up = cur.select(F.col("id").alias("parent"), F.col("seen").alias("above"))
        if cur.join(up, "parent").filter("seen <> above").isEmpty():
            return cur.select("id", "parent", F.col("seen").alias("cycle_id"))
        cur = cur.drop("seen")


@dataclass
class Hierarchy:
    """labels: (id, parent, root, depth, size, chain, pos, pre, light); cycles: (id, parent, cycle_id).

    A chain is named by its upper end, pos counts along it, light counts the
    chains above.  The subtree of a node holds the nodes of the same root with
    pre from its own pre to pre + size - 1; along a chain pre is consecutive.
    """

    labels: DataFrame
    cycles: DataFrame


def separate_cycles(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent, cycle_id): the rows whose parents never end; none of an empty table."""
    return climb(clean_links(rows, id_col, parent_col))[1]


def heavy_paths(rows: DataFrame, id_col: str, parent_col: str) -> Hierarchy:
    """Label every row of a parent table by heavy-path decomposition.

    Closed chains and what hangs below them are separated first and carry no
    labels.  Of equally large children the one with the smallest id is heavy.
    """
    ended, cyclic = climb(clean_links(rows, id_col, parent_col), sizes=True)
    nodes = ended.select("id", "parent", F.col("top").alias("root"), F.col("hops").alias("depth"), "size")
    child = nodes.filter("parent IS NOT NULL")
    heavy = child.groupBy("parent").agg(F.max(F.struct("size", (-F.col("id")).alias("neg"))).alias("m"))
    heavy = heavy.select((-F.col("m.neg")).alias("id"), F.col("m.size").alias("hsize"), F.lit(True).alias("heavy"), F.col("parent").alias("of"))
    nodes = cut(nodes.join(heavy.select("id", "heavy"), "id", "left"))
    chains, _ = climb(nodes.select("id", F.when(F.col("heavy"), F.col("parent")).alias("parent")), cycles=False)
    nodes = cut(nodes.join(chains.select("id", F.col("top").alias("chain"), F.col("hops").alias("pos")), "id"))

    # where the subtree of each upper end starts within its parent's: heavy child first, then by id
    ends = nodes.filter("parent IS NOT NULL AND heavy IS NULL").select("id", "parent", "size")
    slots = cut(ends.repartitionByRange(partitions_for(rows), "parent", "id").withColumn("slot", F.spark_partition_id()))
    whole = slots.groupBy("parent", "slot").agg(F.sum("size").alias("s"))
    whole = whole.withColumn("skip", F.sum("s").over(Window.partitionBy("parent").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("slot", "parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = slots.withColumn("before", F.sum("size").over(w)).join(whole.select("parent", "slot", "skip"), ["parent", "slot"])
    placed = placed.join(heavy.select(F.col("of").alias("parent"), "hsize"), "parent")
    placed = placed.select("id", "parent", (1 + F.col("hsize") + F.coalesce("before", F.lit(0)) + F.coalesce("skip", F.lit(0))).alias("off"))
    up = placed.join(nodes.select(F.col("id").alias("parent"), F.col("chain").alias("above"), F.col("pos").alias("at")), "parent")
    up = up.select("id", F.col("above").alias("parent"), (F.col("at") + F.col("off")).alias("weight"))
    tops = nodes.filter("parent IS NULL").select("id", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("weight"))
    starts, _ = climb(up.unionByName(tops), weigh=True, cycles=False)
    starts = starts.select(F.col("id").alias("chain"), F.col("total").alias("start"), F.col("hops").alias("light"))
    labels = nodes.join(starts, "chain").select("id", "parent", "root", "depth", "size", "chain", "pos", (F.col("start") + F.col("pos")).alias("pre"), "light")
    return Hierarchy(cut(labels), cyclic)


def path_segments(tree: Hierarchy) -> DataFrame:
    """(id, step, chain, upto): the path to each node as pieces of chains, step 0 at the root.

    Each piece is the beginning of a chain, up to the position `upto`.  A node has
    no more pieces than the logarithm of the rows, however deep it lies.
    """
    labels = tree.labels
    above = labels.filter("pos = 0 AND parent IS NOT NULL").select(F.col("id").alias("chain"), F.col("parent").alias("node"))
    above = cut(above.join(labels.select(F.col("id").alias("node"), F.col("chain").alias("chain2"), F.col("pos").alias("upto2")), "node").select("chain", "chain2", "upto2"))
    level = labels.select("id", F.col("light").alias("step"), "chain", F.col("pos").alias("upto"))
    out = level
    for _ in range(labels.agg(F.max("light")).first()[0] or 0):
        level = level.filter("step > 0").join(above, "chain").select("id", (F.col("step") - 1).alias("step"), F.col("chain2").alias("chain"), F.col("upto2").alias("upto"))
        level = cut(level)
        out = out.unionByName(level)
    return out


def _chain_blocks(labels: DataFrame, block: int) -> DataFrame:
    """(chain, part, members): the ids of each chain, in parts of `block` positions, so that a long chain is many rows."""
    part = F.floor(F.col("pos") / block)
    rows = labels.groupBy("chain", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("m"))
    return rows.select("chain", "part", F.transform("m", lambda x: x["id"]).alias("members"))


def full_paths(tree: Hierarchy, block: int = 512) -> DataFrame:
    """(id, path): the ids from the root down to each node.

    Chains are put together in parts of `block` nodes; a node's path is the path
    above its chain, the chain's parts before its own and the beginning of that, so
    that a chain of any length is spread over tasks.  All paths together grow with
    rows times depth: path_segments() gives the same in few rows a node.
    """
    labels = tree.labels
    parts = cut(_chain_blocks(labels, block))
    later = parts.filter("part > 0").select("chain", F.col("part").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("part") - 1)).alias("part"))
    before = later.join(parts, ["chain", "part"]).groupBy("chain", "own").agg(F.array_sort(F.collect_list(F.struct("part", "members"))).alias("b"))
    before = before.select("chain", F.col("own").alias("part"), F.flatten(F.transform("b", lambda x: x["members"])).alias("before"))
    heads = labels.filter("pos = 0").select(F.col("id").alias("chain"), "parent", "light")
    chain = cut(parts.join(before, ["chain", "part"], "left").join(heads, "chain").withColumn("before", F.coalesce("before", F.array().cast("array<long>"))))

    def unfold(level: DataFrame) -> DataFrame:
        one = level.select(F.concat("above", "before").alias("above"), "members", F.posexplode("members").alias("pos", "id"))
        return one.select("id", F.concat("above", F.slice("members", F.lit(1), F.col("pos") + 1)).alias("path"))

    paths = cut(unfold(chain.filter("light = 0").withColumn("above", F.array().cast("array<long>"))))
    out = paths
    for light in range(1, (labels.agg(F.max("light")).first()[0] or 0) + 1):
        level = chain.filter(F.col("light") == light).join(paths.select(F.col("id").alias("parent"), F.col("path").alias("above")), "parent")
        paths = cut(unfold(level))
        out = out.unionByName(paths)
    return out


def descendants(tree: Hierarchy, block: int = 512) -> DataFrame:
    """(ancestor, id, distance): every node below every node, as many rows as nodes times their depth.

    A node's pieces of chains meet those chains' parts; the intervals [pre,
    pre + size) of the labels say the same in one row a node.
    """
    pieces = path_segments(tree).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("upto") / block))))
    parts = cut(_chain_blocks(tree.labels, block))
    at = pieces.join(parts, ["chain", "part"]).select("id", "upto", "part", F.posexplode("members").alias("k", "ancestor"))
    at = at.filter((F.col("part") * block + F.col("k") <= F.col("upto")) & (F.col("ancestor") != F.col("id")))
    depth = tree.labels.select("id", "depth")
    out = at.select("id", "ancestor").join(depth, "id").join(depth.select(F.col("id").alias("ancestor"), F.col("depth").alias("up")), "ancestor")
    return out.select("ancestor", "id", (F.col("depth") - F.col("up")).alias("distance"))
