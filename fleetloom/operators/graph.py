"""Nearest sources and connected components over edge tables, by joins that repeat until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, len of edges in both directions, the shortest of parallel ones. Marked as such, so that it costs nothing to ask again."""
    if getattr(edges, "_both_ways", False):
        return edges
    # Parallel edges meet in one direction: half the rows to shuffle.
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND len IS NOT NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("len").alias("len"))
    here, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    e = stored(e.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(here)).otherwise(F.array(here, back))).alias("e"), "len").select("e.a", "e.b", "len"))
    e._both_ways = True
    return e


def _spread(e: DataFrame, best: DataFrame) -> DataFrame:
    """best (node, at, fresh) when no edge of e brings a node nearer; only fresh nodes send along their edges."""
    best = stored(best)
    while not best.where("fresh").isEmpty():
        front = best.where("fresh").select(F.col("node").alias("a"), "at")
        offers = front.join(e, "a").select(F.col("b").alias("node"), F.struct((F.col("at.dist") + F.col("len")).cast("long").alias("dist"), F.col("at.source").alias("source")).alias("at"))
        both = best.select("node", "at", F.col("at").alias("old")).unionByName(offers.withColumn("old", F.lit(None).cast(best.schema["at"].dataType)))
        best = stored(both.groupBy("node").agg(F.min("at").alias("at"), F.max("old").alias("old")).select("node", "at", (F.col("old").isNull() | (F.col("at") < F.col("old"))).alias("fresh")))
    return best.select("node", "at.dist", "at.source")


def _starts(sources: DataFrame) -> DataFrame:
    return sources.where("node IS NOT NULL").select("node", F.struct(F.lit(0).cast("long").alias("dist"), F.col("node").alias("source")).alias("at"), F.lit(True).alias("fresh")).distinct()


def _placed(overlay: DataFrame, fresh) -> DataFrame:
    return overlay.select("node", F.struct(F.col("dist").cast("long").alias("dist"), "source").alias("at"), fresh.alias("fresh"))


def nearest_source(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, dist, source: the source (node) at the least distance along edges (a, b, len > 0, both ways), the smallest at ties.

    Only nodes that the last round brought nearer send along their edges, so work follows the front. Nodes that no
    source reaches are left out."""
    return _spread(both_ways(edges), _starts(sources))


def _apart(few: DataFrame) -> DataFrame:
    """Those of few (node, rank, others: node, rank) that have a lower rank than all others beside them, and once more among what is beside none of these: no two are neighbours."""
    lowest = F.array_min(F.transform("others", lambda o: o["rank"]))
    marked = few.withColumn("first", lowest.isNull() | (F.col("rank") < lowest))
    first = marked.where("first")
    beside = first.select(F.explode("others.node").alias("node")).distinct()
    free = marked.where("NOT first").join(beside, "node", "left_anti")
    again = free.select("node", F.explode("others").alias("o")).select("node", "o.rank", F.col("o.node").alias("other")).join(free.select(F.col("node").alias("other")), "other", "left_semi")
    least = again.groupBy("node").agg(F.min("rank").alias("lowest"))
    return first.select("node").unionByName(free.join(least, "node", "left").where("lowest IS NULL OR rank < lowest").select("node"))


def trimmed(e: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """e (as both_ways gives it) without its nodes of one edge that aren't in kept (node), and these (node, beside: b, len). No two are neighbours.

    One aggregate and one join, where a round of contracted takes several of each; most rows of a road with places beside it go here."""
    one = e.where("a <> b").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"), F.min("len").alias("len")).where("n = 1").join(kept.select(F.col("node").alias("a")), "a", "left_anti")
    # Of two that have only each other, the larger.
    gone = stored(one.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("a").alias("node"), F.min("len").alias("len")))
    left = e.where("a < b").join(gone.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
    left = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "len").select("e.a", "e.b", "len")
    other = F.when(F.col("node") == F.col("x"), F.col("y")).otherwise(F.col("x"))
    return stored(left), gone.select("node", F.array(F.struct(other.alias("b"), "len")).alias("beside"))


def contracted(e: DataFrame, kept: DataFrame, *, degree: int = 3, least_share: int = 16) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of e (as both_ways gives it) without its nodes of few edges, and those nodes (node, beside: b, len) round by round.

    A round takes out nodes of at most degree edges, no two of them neighbours and none of kept (node), and joins their
    neighbours to each other at the length of the way through them; distances between nodes that are left stay as they are.
    Up to degree 3 that adds no more edges than it removes. Nearly half of a long way goes in a round, so rounds grow with
    the logarithm of its length. It ends when a round takes fewer than one node in least_share."""
    rounds: list[DataFrame] = []
    e = stored(e.where("a <> b"))
    kept = stored(kept.select("node").distinct())
    nodes = e.select("a").distinct().count()
    while True:
        few = e.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") <= degree).join(kept, "node", "left_anti")
        few = few.select("node", F.struct(F.xxhash64("node", F.lit(len(rounds))).alias("hash"), "node").alias("rank"))
        # Lists of at most degree entries.
        beside = e.join(few.select(F.col("node").alias("a"), F.col("rank").alias("own")), "a").join(few.select(F.col("node").alias("b"), "rank"), "b", "left")
        other = F.when(F.col("rank").isNotNull(), F.struct(F.col("b").alias("node"), "rank"))
        few = stored(beside.groupBy(F.col("a").alias("node")).agg(F.first("own").alias("rank"), F.collect_list(other).alias("others")))
        chosen = _apart(few).withColumnRenamed("node", "a")
        gone = stored(e.join(chosen, "a", "left_semi").groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("b", "len")).alias("beside")))
        taken = gone.count()
        if taken:
            ways = gone.select(F.explode("beside").alias("x"), "beside").select("x", F.explode("beside").alias("y")).where("x.b <> y.b")
            ways = ways.select(F.col("x.b").alias("a"), F.col("y.b").alias("b"), (F.col("x.len") + F.col("y.len")).alias("len"))
            left = e.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti")
            e = stored(left.select("a", "b", "len").unionByName(ways).groupBy("a", "b").agg(F.min("len").alias("len")))
            rounds.append(gone)
        nodes -= taken
        if taken * least_share <= nodes or not taken:
            return e, rounds


def nearest_by_shortcuts(edges: DataFrame, sources: DataFrame, **options) -> DataFrame:
    """The rows of nearest_source, for graphs with long ways: nodes of few edges are taken out, what is left is searched, and they are put back.

    A node put back is as near as the nearest of its neighbours makes it; all of these are there by then. Rows that rounds
    write shrink with the graph, so all of them together are a few times as many as its edges."""
    kept = sources.where("node IS NOT NULL").select("node").distinct()
    left, ends = trimmed(both_ways(edges), kept)
    core, rounds = contracted(left, kept, **options)
    best = stored(_spread(core, _starts(sources)))
    for gone in reversed([ends, *rounds]):
        near = best.select(F.col("node").alias("b"), "dist", "source")
        offers = gone.select("node", F.explode("beside").alias("x")).select("node", "x.b", "x.len").join(near, "b")
        back = offers.groupBy("node").agg(F.min(F.struct((F.col("dist") + F.col("len")).cast("long").alias("dist"), "source")).alias("at"))
        best = stored(best.unionByName(back.select("node", "at.dist", "at.source")))
    return best


def add_sources(edges: DataFrame, overlay: DataFrame, sources: DataFrame) -> DataFrame:
    """overlay (node, dist, source) when sources (node) open: only what comes nearer to one of them is looked at."""
    both = _placed(overlay, F.lit(False)).unionByName(_starts(sources))
    best = both.groupBy("node").agg(F.min("at").alias("at"), F.min_by("fresh", "at").alias("fresh"))
    return _spread(both_ways(edges), best)


def remove_sources(edges: DataFrame, overlay: DataFrame, sources: DataFrame) -> DataFrame:
    """overlay (node, dist, source) when sources (node) close: their nodes are cleared, and nodes beside these send again."""
    e = both_ways(edges)
    gone = sources.where("node IS NOT NULL").select(F.col("node").alias("source")).distinct()
    cleared = stored(overlay.join(gone, "source", "left_semi").select("node"))
    beside = e.join(cleared.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct().withColumn("sends", F.lit(True))
    kept = overlay.join(cleared, "node", "left_anti").join(beside, "node", "left")
    return _spread(e, _placed(kept, F.coalesce("sends", F.lit(False))))


def overlay_versions(e: DataFrame, overlay: DataFrame, changes: DataFrame) -> DataFrame:
    """version, node, dist, source: where versions of an overlay (node, dist, source) differ from it; a null dist: no source reaches the node.

    e: as both_ways gives it. changes (version, node, open): the sources that a version has and the overlay lacks, or the other way.
    All versions are searched at once, each only where it differs: nodes that lose their source, and what new ones come nearer to."""
    changes = stored(changes.select("version", "node", "open"))
    at = overlay.select("node", F.struct(F.col("dist").cast("long").alias("dist"), "source").alias("base"))
    cleared = stored(overlay.join(changes.where("NOT open").select("version", F.col("node").alias("source")), "source").select("version", "node").withColumn("cleared", F.lit(True)))
    beside = cleared.select("version", F.col("node").alias("b")).join(e, "b").select("version", F.col("a").alias("node"), "b", "len").join(cleared, ["version", "node"], "left_anti").join(at, "node")
    reached = beside.select("version", F.col("b").alias("node"), F.struct((F.col("base.dist") + F.col("len")).cast("long").alias("dist"), F.col("base.source").alias("source")).alias("at"))
    opened = changes.where("open").select("version", "node", F.struct(F.lit(0).cast("long").alias("dist"), F.col("node").alias("source")).alias("at"))

    def better(offers: DataFrame) -> DataFrame:
        """Of offers those that beat what the overlay has, where that still holds."""
        least = offers.groupBy("version", "node").agg(F.min("at").alias("at"))
        return least.join(at, "node", "left").join(cleared, ["version", "node"], "left").where("cleared OR base IS NULL OR at < base").select("version", "node", "at")

    best = stored(better(reached.unionByName(opened)).withColumn("fresh", F.lit(True)))
    while not best.where("fresh").isEmpty():
        front = best.where("fresh").select("version", F.col("node").alias("a"), "at")
        offers = better(front.join(e, "a").select("version", F.col("b").alias("node"), F.struct((F.col("at.dist") + F.col("len")).cast("long").alias("dist"), F.col("at.source").alias("source")).alias("at")))
        both = best.select("version", "node", "at", F.col("at").alias("old")).unionByName(offers.withColumn("old", F.lit(None).cast(best.schema["at"].dataType)))
        best = stored(both.groupBy("version", "node").agg(F.min("at").alias("at"), F.max("old").alias("old")).select("version", "node", "at", (F.col("old").isNull() | (F.col("at") < F.col("old"))).alias("fresh")))
    lost = cleared.join(best, ["version", "node"], "left_anti").select("version", "node", F.lit(None).cast("long").alias("dist"), F.lit(None).cast(overlay.schema["source"].dataType).alias("source"))
    return best.select("version", "node", "at.dist", "at.source").unionByName(lost)


def moved_on(overlay: DataFrame, changed: DataFrame) -> DataFrame:
    """overlay with the rows that one version of it changes (node, dist, source)."""
    return overlay.join(changed, "node", "left_anti").select("node", "dist", "source").unionByName(changed.where("dist IS NOT NULL").select("node", "dist", "source"))


def _stars(edges: DataFrame) -> bool:
    """Whether all edges (a, b) lead to a root: no node is both an a and a b, none is an a twice."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("from"), F.lit(0).alias("to")), F.struct(F.col("b").alias("node"), F.lit(0).alias("from"), F.lit(1).alias("to")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.from").alias("from"), F.max("e.to").alias("to"))
    return nodes.where("`from` + `to` > 1 AND `from` > 0").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges (a, b) between different nodes, by large and small stars in turn.

    Each step is joins and aggregates over edges; a node with many edges is only an aggregation key and, in joins, one
    row on the other side. Tables in the shared folder cut the lineage after each round."""
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
        links = stored(small.select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).where("a <> b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b), those with an edge to themselves only included."""
    e = stored(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return nodes.join(roots(e), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def stop_clusters(stops: DataFrame, *, min_vehicles: int, approved: DataFrame | None = None) -> DataFrame:
    """component, cells, stops, vehicles of clusters of cells (vin, x, y) that touch, corners included; with lat and lon, their mean over stops.

    approved: cells (x, y) that belong to no cluster."""
    at = F.col("x") * 2**32 + F.col("y")
    places = [c for c in ("lat", "lon") if c in stops.columns]
    stops = stops.where("x IS NOT NULL AND y IS NOT NULL")
    if approved is not None:
        stops = stops.join(approved.select("x", "y").distinct(), ["x", "y"], "left_anti")
    cells = stored(stops.groupBy("x", "y", "vin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in places]))
    spots = cells.select("x", "y").distinct()
    # Half of the eight neighbours and the cell itself: the others are the same links seen from the other end.
    near = spots.select(at.alias("a"), F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])).alias("p")).select("a", "p.x", "p.y")
    edges = near.join(spots, ["x", "y"]).select("a", at.alias("b"))
    of = cells.join(components(edges), at == F.col("node"))
    found = of.groupBy("component").agg(F.countDistinct("node").alias("cells"), F.sum("n").alias("stops"), F.countDistinct("vin").alias("vehicles"), *[(F.sum(c) / F.sum("n")).alias(c) for c in places])
    return found.where(F.col("vehicles") >= min_vehicles)
