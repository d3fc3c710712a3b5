"""Link authority by iterated joins; lineage is cut by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, materialise

CUT_EVERY = 2


def edges_of(links: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges without self-links and nulls. Partial aggregation takes repeated links out before the shuffle."""
    return links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, seeds: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """RK-20/22: node, rank. Dangling mass goes to the teleport vector: uniform over all nodes, or over seeds (node).

    start (node, rank) warms the iteration. Mass per target is pre-aggregated map-side, so hot targets don't gather.
    """
    edges = materialise(edges, "edges")
    out_degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = nodes_of(edges)
    if seeds is None:
        teleport = nodes.withColumn("_t", F.lit(1.0))
    else:
        teleport = nodes.join(seeds.select("node", F.lit(1.0).alias("_s")).distinct(), "node", "left").select("node", F.coalesce("_s", F.lit(0.0)).alias("_t"))
    total = teleport.agg(F.sum("_t").alias("_all"), F.count("*").alias("_n"))
    base = attach(teleport, total).select("node", (F.col("_t") / F.col("_all")).alias("jump"))
    base = materialise(base.join(out_degree.withColumnRenamed("src", "node"), "node", "left"), "nodes")
    ranks = base.select("node", F.col("jump").alias("rank"))
    if start is not None:
        ranks = base.join(start.select("node", F.col("rank").alias("_r")), "node", "left").select("node", F.coalesce("_r", "jump").alias("rank"))
    for i in range(iterations):
        known = ranks.join(base, "node")
        dangling = known.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_d"))
        given = known.where("degree is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("_share"))
        received = edges.join(given, "src").groupBy("dst").agg(F.sum("_share").alias("_in")).withColumnRenamed("dst", "node")
        ranks = attach(base.join(received, "node", "left"), dangling).select(
            "node", (F.lit(1 - damping) * F.col("jump") + F.lit(damping) * (F.coalesce("_in", F.lit(0.0)) + F.col("_d") * F.col("jump"))).alias("rank")
        )
        if (i + 1) % CUT_EVERY == 0:
            ranks = materialise(ranks, "ranks")
    return ranks


def log_rank(ranks: DataFrame) -> DataFrame:
    """RK-21: ln(1 + rank * nodes)."""
    n = ranks.agg(F.count("*").alias("_n"))
    return attach(ranks, n).select("node", "rank", F.log1p(F.col("rank") * F.col("_n")).alias("log_rank"))


def hits(edges: DataFrame, iterations: int = 5) -> DataFrame:
    """RK-23: node, hub, authority, each normalised to a sum of 1."""
    edges = materialise(edges, "edges")
    nodes = nodes_of(edges)
    hubs = nodes.withColumn("hub", F.lit(1.0))
    authorities = None
    scaled = lambda df, c: attach(df, df.agg(F.sum(c).alias("_s"))).withColumn(c, F.col(c) / F.col("_s")).drop("_s")
    for i in range(iterations):
        authorities = scaled(edges.join(hubs.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum("hub").alias("authority")).withColumnRenamed("dst", "node"), "authority")
        hubs = scaled(edges.join(authorities.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.sum("authority").alias("hub")).withColumnRenamed("src", "node"), "hub")
        if (i + 1) % 2 == 0:
            hubs, authorities = materialise(hubs, "hubs"), materialise(authorities, "authorities")
    return nodes.join(hubs, "node", "left").join(authorities, "node", "left").select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def _state(edges: DataFrame) -> tuple:
    """Rows and an order-free hash: two tables of distinct edges with one state are equal."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node). Alternating large-star and small-star contraction: rounds grow with the log of the longest path.

    edges: src, dst of one type; direction is ignored. One row a round reaches the driver, which tells whether anything changed.
    Labels that still change after max_rounds are no result: RuntimeError.
    """
    e = materialise(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct(), "cc")
    before = _state(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(smallest, "a")
        e = materialise(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components still changed after {max_rounds} rounds")
    labels = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node")).distinct().join(labels.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return labels.unionByName(roots)


def salsa(edges: DataFrame) -> DataFrame:
    """RK-23: node, authority by the random walk from authorities over hubs. On a connected graph it is the in-degree's share; components weigh by their authorities.

    Within a component the walk ends at in-degree / edges of the component, so no iteration is needed.
    """
    edges = materialise(edges, "edges")
    sides = edges.select(F.concat(F.lit("h:"), "src").alias("src"), F.concat(F.lit("a:"), "dst").alias("dst"))
    parts = connected_components(sides)
    degree = edges.groupBy("dst").agg(F.count("*").alias("_in")).select(F.concat(F.lit("a:"), "dst").alias("node"), "_in")
    own = materialise(degree.join(parts, "node"), "salsa")
    sizes = own.groupBy("component").agg(F.sum("_in").alias("_edges"), F.count("*").alias("_nodes"))
    total = own.agg(F.count("*").alias("_all"))
    return attach(own.join(sizes, "component"), total).select(F.substring("node", 3, 1 << 20).alias("node"), (F.col("_in") / F.col("_edges") * F.col("_nodes") / F.col("_all")).alias("authority"))


def trust_ratio(ranks: DataFrame, trust: DataFrame) -> DataFrame:
    """RK-22: node, rank, trust, ratio of rank to trust: high where links come from nowhere that is trusted."""
    both = ranks.join(trust.select("node", F.col("rank").alias("trust")), "node", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
    return both.select("node", "rank", "trust", F.when(F.col("trust") > 0, F.col("rank") / F.col("trust")).alias("ratio"))
