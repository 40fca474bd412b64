"""Themes of a scoped entity graph: edge threshold, bridges, groups and their documents; communities over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from . import graph, ranges


def kept_edges(nodes: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """``src, dst, weight`` between two of the nodes at or over a weight: no self loops, one row a pair with its largest weight."""
    known = nodes.select(F.col("entity_id").alias("_id"))
    inner = edges.where((F.col("src") != F.col("dst")) & (F.col("weight") >= least)).join(known, F.col("src") == F.col("_id"), "left_semi").join(known, F.col("dst") == F.col("_id"), "left_semi")
    return inner.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``src, dst``: the edges of a forest that spans every component.

    Each round every tree so far takes its least edge to another tree, by a hash of the edge, and the trees that meet become one; trees at least
    double, so rounds are as many as the logarithm of the nodes.
    """
    key = F.struct(F.xxhash64("src", "dst").alias("h"), "src", "dst")
    left = stored(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b")), "left")
    forest = None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("tree"), key.alias("edge"), "a", "b").unionByName(left.select(F.col("b").alias("tree"), key.alias("edge"), "a", "b"))
        best = ends.groupBy("tree").agg(F.min(F.struct("edge", "a", "b")).alias("x"))
        best = stored(best.select("x.edge.src", "x.edge.dst", "x.a", "x.b").distinct(), "taken")
        forest = best.select("src", "dst") if forest is None else forest.unionByName(best.select("src", "dst"))
        trees = graph.components(best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        to = lambda end: trees.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        # each end of an edge that is left lies in a tree that took an edge, as it has one
        left = stored(left.join(to("a"), "a").join(to("b"), "b").where("_a <> _b").select("src", "dst", F.col("_a").alias("a"), F.col("_b").alias("b")), "left")
    return left.select("src", "dst") if forest is None else forest


def tree_tours(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """``u, v, component, rest``: both directions of every tree edge, and how many steps of its tree's tour follow.

    A tour takes each edge once in either direction: after ``u, v`` comes ``v`` and its next neighbour behind ``u``, in a circle.  It begins at the
    root, the tree's ``component`` (``node, component`` for all nodes).  Steps are counted by doubling, so rounds are as many as the logarithm of
    the longest tour.
    """
    both = tree.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(tree.select("dst", "src"))
    arcs = stored(ranges.numbered(both, [], [F.col("u"), F.col("v")], "k"), "arcs")
    first = arcs.groupBy("u").agg(F.min("k").alias("first"))
    after = arcs.select((F.col("k") - 1).alias("k"), F.col("u").alias("_u"))
    turn = arcs.join(after, "k", "left").join(first, "u").select("u", "v", "k", F.when(F.col("_u") == F.col("u"), F.col("k") + 1).otherwise(F.col("first")).alias("turn"))
    back = turn.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("turn").alias("next"))
    starts = first.join(roots.where("node = component").select(F.col("node").alias("u")), "u").select(F.col("first").alias("next"), F.lit(True).alias("_start"))
    steps = arcs.join(back, ["u", "v"]).join(starts, "next", "left").select("k", F.when(F.col("_start").isNull(), F.col("next")).alias("next"))
    steps = stored(steps.withColumn("rest", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")), "steps")
    while not steps.where("next IS NOT NULL").isEmpty():
        far = steps.select(F.col("k").alias("next"), F.col("next").alias("_next"), F.col("rest").alias("_rest"))
        steps = stored(steps.join(far, "next", "left").select("k", F.col("_next").alias("next"), (F.col("rest") + F.coalesce("_rest", F.lit(0))).alias("rest")), "steps")
    return arcs.join(steps.select("k", "rest"), "k").join(roots.select(F.col("node").alias("u"), "component"), "u").select("u", "v", "component", "rest")


def bridges(edges: DataFrame) -> DataFrame:
    """``src, dst, below, beyond``: the edges on no cycle, and the nodes on either side of each; the smallest node of the component lies beyond.

    Each edge outside of a spanning forest gets a random number, which one of its ends adds and the other takes away.  A tree edge is a bridge if
    the numbers below it cancel out, so that no other edge leaves the subtree (an error has probability 2**-63).  A subtree is a stretch of the
    tree's tour, and sums of stretches are differences of running sums, however deep the tree is.
    """
    pairs = stored(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    roots = stored(graph.components(pairs), "roots")
    tree = stored(spanning_forest(pairs), "tree")
    tour = stored(tree_tours(tree, roots), "tour")
    number = F.xxhash64("src", "dst", F.lit(11)).cast("decimal(38,0)")
    marks = pairs.join(tree, ["src", "dst"], "left_anti").select(F.explode(F.array(F.struct(F.col("src").alias("node"), number.alias("mark")), F.struct(F.col("dst").alias("node"), (-number).alias("mark")))).alias("x")).select("x.*")
    own = marks.groupBy(F.col("node").alias("v")).agg(F.sum("mark").alias("mark"))
    up = tour.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("rest").alias("_rest"))
    steps = tour.join(up, ["u", "v"]).withColumn("down", F.col("rest") > F.col("_rest")).join(own, "v", "left")
    steps = steps.select("u", "v", "component", "rest", "down", F.when(F.col("down"), F.coalesce("mark", F.lit(0))).otherwise(0).cast("decimal(38,0)").alias("mark"), F.col("down").cast("long").alias("size"))
    order = [F.desc("rest")]
    summed = ranges.running(ranges.running(steps, ["component"], order, F.col("mark"), "marks"), ["component"], order, F.col("size"), "sizes")
    summed = stored(summed, "summed")
    down = summed.where("down").select("u", "v", "component", (F.col("marks") - F.col("mark")).alias("m0"), (F.col("sizes") - F.col("size")).alias("s0"))
    ends = summed.where("NOT down").select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("marks").alias("m1"), F.col("sizes").alias("s1"))
    cut = down.join(ends, ["u", "v"]).where("m0 = m1").join(roots.groupBy("component").agg(F.count("*").alias("all")), "component")
    below = (F.col("s1") - F.col("s0")).cast("long")
    return cut.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), below.alias("below"), (F.col("all") - below).alias("beyond"))


def grouped(nodes: DataFrame, edges: DataFrame, least: float = 0.2, keep: float = 0.5, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked groups of nodes: ``group_id, entity_id`` and ``group_id, members, score``.

    Weak bridges (under ``keep``) with two or more nodes on both sides go, all at once; the rest's components are the groups, a node without an
    edge its own.  A group's score is the weight inside; ranks are by score, size, and smallest member.
    """
    strong = stored(kept_edges(nodes, edges, least), "strong")
    weak = bridges(strong).where("below >= 2 AND beyond >= 2").join(strong.where(F.col("weight") < keep), ["src", "dst"], "left_semi").select("src", "dst")
    left = stored(strong.join(weak, ["src", "dst"], "left_anti"), "left")
    found = graph.components(left.select("src", "dst"))
    labels = stored(nodes.select("entity_id").distinct().join(found.withColumnRenamed("node", "entity_id"), "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("component")), "labels")
    inside = left.join(labels.select(F.col("entity_id").alias("src"), "component"), "src").groupBy("component").agg(F.sum("weight").alias("score"))
    sized = labels.groupBy("component").agg(F.count("*").alias("members")).join(inside, "component", "left").select("component", "members", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    order = [F.desc("score"), F.desc("members"), F.col("component")]
    best = sized.orderBy(*order).limit(most) if most else sized
    ranked = ranges.numbered(best, [], order).withColumn("group_id", (F.col("k") - 1).cast("long"))
    return labels.join(ranked, "component").select("group_id", "entity_id"), ranked.select("group_id", "members", "score")


def theme_documents(groups: DataFrame, mentions: DataFrame, most: int = 5) -> DataFrame:
    """``group_id, doc_id, members``: each group's documents by the number of its members that they mention."""
    counted = groups.join(mentions.select("doc_id", "entity_id").distinct(), "entity_id").groupBy("group_id", "doc_id").agg(F.count("*").alias("members"))
    order = Window.partitionBy("group_id").orderBy(F.desc("members"), "doc_id")
    return counted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def seeds(entities: DataFrame, query: str, most: int = 10) -> DataFrame:
    """``entity_id, name, df``: the entities whose name or key is the query, else those that contain it, most documents first."""
    needle = query.strip().lower()
    name, key = F.lower("name"), F.lower("key")
    tier = F.when((name == needle) | (key == needle), 0).when(F.contains(name, F.lit(needle)) | F.contains(key, F.lit(needle)), 1)
    rows = entities.withColumn("_tier", tier if needle else F.lit(None)).where("_tier IS NOT NULL")
    best = rows.agg(F.min("_tier").alias("_best"))
    return rows.join(F.broadcast(best), F.col("_tier") == F.col("_best")).orderBy(F.desc("df"), "key", "entity_id").limit(most).select("entity_id", "name", "df")


def local_documents(edges: DataFrame, mentions: DataFrame, start: DataFrame, depth: int = 2, floor: float = 0.2, frontier: int = 200, most: int = 20) -> DataFrame:
    """``doc_id, score``: documents by the summed weight of the start entities (1 each) and what traversal reaches from them."""
    reached = graph.traverse(edges, start.select("entity_id"), depth, floor, frontier).select("entity_id", "affinity")
    weights = start.select("entity_id", F.lit(1.0).alias("affinity")).unionByName(reached)
    return graph.documents_by_weight(mentions, weights).orderBy(F.desc("score"), "doc_id").limit(most)


def community_documents(labels: DataFrame, mentions: DataFrame) -> DataFrame:
    """``community, doc_id, n``: mentions of each community's members by document."""
    return labels.join(mentions, labels.node == mentions.entity_id).groupBy("community", "doc_id").agg(F.sum("mention_count").alias("n"))


def tainted(labels: DataFrame, mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """``community`` of those with a member that a confidential document mentions."""
    secret = mentions.join(docs.where("sensitivity = 'confidential'").select("doc_id"), "doc_id", "left_semi").select("entity_id")
    return labels.join(secret, labels.node == secret.entity_id, "left_semi").select("community").distinct()


def built(edges: DataFrame, known: str | None) -> tuple[str, DataFrame | None]:
    """The edges' fingerprint and their communities; no communities if the fingerprint is the known one, as nothing changed."""
    now = fingerprint(edges).first()[0]
    return now, None if now == known else graph.louvain(edges)


def fingerprint(edges: DataFrame) -> DataFrame:
    """``fingerprint``: a digest of the whole edge table that its order doesn't change; lines are digested where they lie and only their sums meet."""
    line = F.sha2(F.concat_ws("|", "src", "dst", F.format_number("weight", 6)), 256)
    part = lambda k: F.conv(F.substring(line, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")
    sums = edges.agg(*[F.coalesce(F.sum(part(k)), F.lit(0)).alias(f"s{k}") for k in range(8)], F.count("*").alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", "n", *[f"s{k}" for k in range(8)]), 256).alias("fingerprint"))
