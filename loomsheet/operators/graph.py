"""Graph algorithms over edge tables (src, dst[, weight]) by iterated joins with checkpoints."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.session import checkpoint


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(vertex, component): the least vertex of each connected component.

    Alternating large-star and small-star steps: every vertex links its greater, then its lesser
    neighbours to the least of them, until no edge changes.  Rounds grow with the logarithm of the
    longest chain.  A vertex of many edges is never gathered: its least neighbour is an aggregate with
    map-side combine, joined back on the vertex.
    """
    now = checkpoint(edges.select("src", "dst").filter("src <> dst and src is not null and dst is not null").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(most):
        both = _pairs(now, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: a vertex and its lesser neighbours link to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("u", "v", "m")
        now = checkpoint(_pairs(small, ("m", "v"), ("m", "u")).filter("u <> v").distinct())
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    return _pairs(now, ("v", "u"), ("u", "u")).select(F.col("u").alias("vertex"), F.col("v").alias("component")).distinct()


def _pairs(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """(u, v) of several pairs of columns of each row, in one pass."""
    made = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in columns])
    return df.select(F.explode(made).alias("p")).select("p.u", "p.v")


def topological_levels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(vertex, level) by removing, round by round, the vertices nothing points to; those on or behind a cycle have none."""
    rest = checkpoint(edges.select("src", "dst").distinct())
    done = None
    left = checkpoint(rest.select(F.col("src").alias("vertex")).union(rest.select("dst")).distinct())
    for level in itertools.count():  # every round but the last removes a vertex
        if level == most:
            raise RuntimeError("levels did not settle")
        free = left.join(rest.select(F.col("dst").alias("vertex")).distinct(), "vertex", "left_anti")
        marked = checkpoint(free.withColumn("level", F.lit(level)))
        if marked.isEmpty():
            break
        done = marked if done is None else done.unionByName(marked)
        if level % 50 == 49:
            done = checkpoint(done)
        left = checkpoint(left.join(marked, "vertex", "left_anti"))
        rest = checkpoint(rest.join(marked.select(F.col("vertex").alias("src")), "src", "left_anti"))
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def minimum_spanning_forest(edges: DataFrame, most: int = 64) -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest by Borůvka's rounds; ties by the vertices' order."""
    base = checkpoint(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    label = checkpoint(base.select(F.col("src").alias("vertex")).union(base.select("dst")).distinct().withColumn("part", F.col("vertex")))
    tree = None
    for _ in range(most):
        a, b = label.select(F.col("vertex").alias("src"), F.col("part").alias("ps")), label.select(F.col("vertex").alias("dst"), F.col("part").alias("pd"))
        across = base.join(a, "src").join(b, "dst").filter("ps <> pd")
        edge = F.struct("weight", "src", "dst").alias("e")
        best = across.select(F.col("ps").alias("part"), edge).unionByName(across.select(F.col("pd").alias("part"), edge)).groupBy("part").agg(F.min("e").alias("e"))
        chosen = checkpoint(best.select("e.src", "e.dst", "e.weight").distinct())
        if chosen.isEmpty():
            break
        tree = chosen if tree is None else checkpoint(tree.unionByName(chosen).distinct())
        links = chosen.join(a, "src").join(b, "dst").select(F.col("ps").alias("src"), F.col("pd").alias("dst"))
        merged = components(links).select(F.col("vertex").alias("part"), "component")
        label = checkpoint(label.join(merged, "part", "left").select("vertex", F.coalesce("component", "part").alias("part")))
    return tree if tree is not None else base.limit(0)


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None, directed: bool = False) -> DataFrame:
    """(source, vertex, distance) from each source by relaxing the frontier; unreachable vertices have no row.

    Rounds go on until nothing changes: after as many as there are vertices only a cycle of negative
    weight still does, which is an error, as is not settling within ``most`` rounds.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    e = checkpoint(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    known = checkpoint(sources.select(F.col("vertex").alias("source"), "vertex", F.lit(0.0).alias("distance")).distinct())
    frontier = known
    if most is None:
        most = e.select("dst").distinct().count() + 1
    for _ in range(most):
        step = frontier.join(e, F.col("vertex") == F.col("src")).select("source", F.col("dst").alias("vertex"), (F.col("distance") + F.col("weight")).alias("new"))
        step = step.groupBy("source", "vertex").agg(F.min("new").alias("new"))
        better = checkpoint(step.join(known, ["source", "vertex"], "left").filter("distance is null or new < distance").select("source", "vertex", F.col("new").alias("distance")))
        if better.isEmpty():
            break
        known = checkpoint(known.unionByName(better).groupBy("source", "vertex").agg(F.min("distance").alias("distance")))
        frontier = better
    else:
        raise RuntimeError("distances did not settle")
    return known


def pivot_distances(edges: DataFrame, first, pivots: int) -> DataFrame:
    """(source, vertex, distance) from pivots chosen farthest first; ties by the least vertex."""
    out = None
    pivot = first
    for _ in range(pivots):
        at = edges.sparkSession.createDataFrame([(pivot,)], ["vertex"])
        reached = distances(edges, at)
        out = reached if out is None else checkpoint(out.unionByName(reached))
        nearest = out.groupBy("vertex").agg(F.min("distance").alias("d")).filter("d > 0")
        row = nearest.orderBy(F.desc("d"), F.asc("vertex")).first()
        if row is None:
            break
        pivot = row["vertex"]
    return out


def pivot_mds(edges: DataFrame, first, pivots: int = 8) -> DataFrame:
    """(vertex, x, y): pivot multidimensional scaling.  The small pivot matrix is solved on the driver, positions are a projection."""
    rows = pivot_distances(edges, first, pivots)
    squared = rows.select("source", "vertex", (F.col("distance") * F.col("distance")).alias("d"))
    by_pivot, by_vertex = squared.groupBy("source").agg(F.avg("d").alias("mp")), squared.groupBy("vertex").agg(F.avg("d").alias("mv"))
    whole = squared.agg(F.avg("d")).scalar()
    centred = checkpoint(squared.join(by_pivot, "source").join(by_vertex, "vertex").select("source", "vertex", (-0.5 * (F.col("d") - F.col("mp") - F.col("mv") + whole)).alias("c")))
    other = centred.select(F.col("source").alias("other"), "vertex", F.col("c").alias("k"))
    square = centred.join(other, "vertex").groupBy("source", "other").agg(F.sum(F.col("c") * F.col("k")).alias("s")).collect()  # pivots by pivots
    names = sorted({r["source"] for r in square})
    m = np.zeros((len(names), len(names)))
    for r in square:
        m[names.index(r["source"]), names.index(r["other"])] = r["s"]
    _, vectors = np.linalg.eigh(m)
    axes = [vectors[:, -1], vectors[:, -2] if len(names) > 1 else np.zeros(len(names))]
    weights = [(n, *[float(a[i] * np.sign(a[np.argmax(np.abs(a))] or 1)) for a in axes]) for i, n in enumerate(names)]
    table = edges.sparkSession.createDataFrame(weights, ["source", "wx", "wy"])
    return centred.join(F.broadcast(table), "source").groupBy("vertex").agg(F.sum(F.col("c") * F.col("wx")).alias("x"), F.sum(F.col("c") * F.col("wy")).alias("y"))  # one row a pivot


def feedback_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) of edges into a vertex still on the stack of a depth-first search, per component, in the vertices' order.

    A vertex without a way on can't be on the stack when it is met, so edges into such vertices are
    peeled off first, round by round, which changes nothing in the rest.  The search itself goes by
    order and is one task for each component of what is left: that is its bound.
    """
    edges = checkpoint(edges.filter("src <> dst").select("src", "dst").distinct())
    size = edges.count()
    while True:
        left = checkpoint(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        edges = left
        if now >= 0.99 * size:  # also where none is left
            break
        size = now
    found = components(edges).select(F.col("vertex").alias("src"), "component")
    rows = edges.filter("src <> dst").select("src", "dst").distinct().join(found, "src")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for s, d in sorted(zip(pdf.src, pdf.dst, strict=True)):
            after.setdefault(s, []).append(d)
        state: dict = {}
        back = []
        for root in sorted(set(pdf.src) | set(pdf.dst)):
            if root in state:
                continue
            state[root] = 1
            stack = [(root, iter(after.get(root, ())))]
            while stack:
                vertex, rest = stack[-1]
                step = next(rest, None)
                if step is None:
                    state[vertex] = 2
                    stack.pop()
                elif state.get(step) == 1:
                    back.append((vertex, step))
                elif step not in state:
                    state[step] = 1
                    stack.append((step, iter(after.get(step, ()))))
        return pd.DataFrame(back, columns=["src", "dst"])

    kind = dict(edges.dtypes)["src"]
    return rows.groupBy("component").applyInPandas(search, f"src {kind}, dst {kind}")
