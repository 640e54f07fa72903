"""Components of similarity links, without all pairs of a group and without collecting anything.

Candidates come as rows (band, id, size): ids of one band value may be similar. Every id is first
tested against the smallest id of each of its bands, so a group costs one pair for each member.
Union-find over the links found joins most groups. What is left are groups with members in different
components; there only members outside the group's largest component meet members of other
components, if their sizes (and what else the caller knows) allow the similarity. After that every candidate pair is linked, tested, or inside one component already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.llm.storage import discard, saved

#: Links need a Jaccard similarity of at least LEAST[0] / LEAST[1].
LEAST = (3, 4)


def sizes_allow(a: str, b: str):
    """Sets of these sizes can be similar enough."""
    return (F.least(a, b) * LEAST[1]) >= (F.greatest(a, b) * LEAST[0])


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every id with an edge ``a, b``: the smallest id it is connected with.

    Alternates the two star steps of distributed union-find, each a grouped minimum and a join;
    hubs are the unique side of the join, so their edges can be split. Self edges and repeated
    edges do no harm; no edges give no rows.
    """
    state = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return state.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(
                state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        mark = now
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = state.join(low, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        old, state = state, saved(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old)


def candidate_groups(members: DataFrame) -> DataFrame:
    """Distinct rows (band, id, size) of bands with two ids or more, with the band's smallest id and rows (as given; they may repeat)."""
    head = members.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count(F.lit(1)).cast("int").alias("n"))
    head = saved(head.where("head <> last").drop("last"))
    rows = saved(members.join(head, "band").select("band", "id", "size", "head", "n").distinct())
    discard(head)
    return rows


def open_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components with a band in common, two bands at least, and sizes that allow a link."""
    shared = rows.groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("bands"))  # no more bands than one id has
    rows = rows.join(shared, "id")
    both = F.array_intersect("l.bands", "r.bands")
    meets = (
        (F.col("l.band") == F.col("r.band")) & (F.col("l.component") != F.col("r.component"))
        & ((F.col("r.component") == F.col("r.main")) | (F.col("l.id") < F.col("r.id")))
        & sizes_allow("l.size", "r.size") & (F.size(both) >= 2) & (F.array_min(both) == F.col("l.band"))
    )
    pairs = rows.where("component <> main").alias("l").join(rows.alias("r"), meets)
    return pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))


def linked(groups: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """``id, component`` of every id with a verified link.

    ``verify`` keeps the true links of pairs ``a, b``; ``rest`` finds what links the components of groups that the first round
    left in several, from rows (band, id, size, component, main); without it ``open_pairs`` are verified. ``pairs`` are
    verified with those of the first round. Stored ``groups`` are deleted on the way.
    """
    star = groups.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    edges = saved(verify((star.union(pairs) if pairs is not None else star).distinct()))
    if groups.isEmpty():
        return components(edges)
    first = saved(components(edges))
    # a band of two is settled by its one pair
    rows = groups.where("n > 2").drop("n").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sides = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sides.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    main = main.where("k > 1 and n > 2").select("band", "main")
    open_ = saved(rows.where("id <> head").select("band", "id", "size", "component").join(main, "band"))
    discard(groups)
    more = rest(open_) if rest else verify(open_pairs(open_).distinct())
    return components(edges.select("a", "b").union(more.select("a", "b")))
