"""Following aliases to what they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablelens.plans.groups import Hot, hot_group_rows
from tablelens.plans.joins import balanced_join
from tablelens.plans.tables import materialize


def _counted(step: DataFrame) -> tuple[DataFrame, int]:
    """A round's table, written, and how many of its ids are open: counted on the way."""
    seen = Observation()
    table = materialize(step.observe(seen, F.count_if(~F.col("closed")).alias("open")))
    return table, seen.get["open"]


def resolve_aliases(aliases: DataFrame, id: str = "id", target: str = "target") -> DataFrame:
    """Follow ``target`` from each id until something that is no alias.

    Ids are unique. The result is ``(id, root, hops, cyclic)``; ids that run into a cycle have
    ``root`` and ``hops`` NULL. An id without a target is its own root.

    Every round doubles how far each open id has been followed, so the number
    of rounds is the logarithm of the longest chain. Each round's table is
    written out, which keeps the plan short, and only open ids take part.
    While any open id leads to a root, some id is closed in every round; a
    round that closes none therefore proves the rest to be cyclic.
    """
    start = aliases.select(
        F.col(id).alias("id"),
        F.coalesce(target, id).alias("ptr"),
        F.col(target).isNotNull().cast("long").alias("hops"),
        F.col(target).isNull().alias("closed"),
    )
    written, left = _counted(start)
    open_ids, closed = written.where(~F.col("closed")), written.where("closed")
    # What has no target is its own root, so no pointer to it leads any further.
    known = None
    while left:
        followed = open_ids if known is None else known.unionByName(open_ids)
        onward = followed.select(
            F.col("id").alias("ptr"),
            F.col("ptr").alias("_ptr"),
            F.col("hops").alias("_hops"),
            F.col("closed").alias("_closed"),
        )
        # A pointer to an id that is not listed has reached its root.
        few = left <= hot_group_rows(aliases.sparkSession)
        step = balanced_join(
            open_ids.select("id", "ptr", "hops"),
            onward,
            ["ptr"],
            "left",
            right_unique=True,
            hot=[] if few else None,
        ).select(
            "id",
            F.coalesce("_ptr", "ptr").alias("ptr"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.coalesce("_closed", F.lit(True)).alias("closed"),
        )
        before = left
        written, left = _counted(step)
        open_ids = written.where(~F.col("closed"))
        done = written.where("closed")
        closed = closed.unionByName(done)
        known = done if known is None else known.unionByName(done)
        if left == before:
            break
    roots = closed.select(
        F.col("id").alias(id), F.col("ptr").alias("root"), "hops", F.lit(False).alias("cyclic")
    )
    if not left:
        return roots
    cycles = open_ids.select(
        F.col("id").alias(id),
        F.lit(None).cast(aliases.schema[id].dataType).alias("root"),
        F.lit(None).cast("long").alias("hops"),
        F.lit(True).alias("cyclic"),
    )
    return roots.unionByName(cycles)


def alias_hops(
    aliases: DataFrame, id: str = "id", target: str = "target", ids: DataFrame | None = None
) -> DataFrame:
    """One row per hop on the way of an id to its root: ``(id, hop, via, cyclic)``.

    ``hop`` counts from 1 and ``via`` is what the hop leads to. ``ids`` (a table whose first
    column names them) limits whose ways are listed; their number times their length is
    the size of the result. An id without a target has no row, nor has one that is not
    listed. On a way into a cycle the hops end before one would lead to what was passed already,
    the id itself included; their rows say so in ``cyclic``.

    Rounds double the hops listed: ways of up to ``n`` hops need the logarithm of ``n`` rounds,
    each a join of the rows so far with a table of jumps, which is joined with itself to double the
    jumps. Every round is written, so plans stay short.
    """
    resolved = resolve_aliases(aliases, id, target).select(F.col(id).alias("id"), "hops", "cyclic")
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        resolved = resolved.join(wanted, "id", "left_semi")
    begun = materialize(resolved.where("cyclic OR hops > 0"))
    longest, n_cyclic, n_ways = begun.agg(F.max("hops"), F.count_if("cyclic"), F.count("*")).first()
    start = (F.lit(0).cast("long").alias("hop"), F.col("id").alias("via"))
    ways = begun.where("NOT cyclic").select("id", *start)
    rings = begun.where("cyclic").select("id", *start)
    jumps = materialize(
        aliases.where(F.col(target).isNotNull()).select(F.col(id).alias("via"), F.col(target).alias("_to"))
    )
    n_jumps, bar = jumps.count(), hot_group_rows(aliases.sparkSession)
    found = None
    reach = 1  # the hops of one jump; ways of fewer hops than this are listed
    while reach <= (longest or 0) or n_cyclic:
        # No key can be hot among so few rows.
        hot = [] if max(n_jumps, 2 * reach * n_ways) <= bar else None
        if reach <= (longest or 0):
            ways = materialize(ways.unionByName(_jumped(ways, jumps, reach, hot)))
        if n_cyclic:
            # A way that came to a place twice is complete; the first times are its hops.
            longer = materialize(rings.unionByName(_jumped(rings, jumps, reach, hot)))
            firsts = longer.groupBy("id", "via").agg(F.min("hop").alias("hop"), F.count("*").alias("_n"))
            firsts = materialize(firsts)
            ended = materialize(firsts.where("_n > 1").select("id").distinct())
            complete = firsts.join(ended, "id", "left_semi").select("id", "hop", "via")
            found = complete if found is None else found.unionByName(complete)
            rings = materialize(longer.join(ended, "id", "left_anti"))
            n_cyclic = rings.where("hop = 0").count()
        reach *= 2
        if reach <= (longest or 0) or n_cyclic:
            onward = jumps.select(F.col("via").alias("_to"), F.col("_to").alias("_next"))
            doubled = balanced_join(jumps, onward, ["_to"], right_unique=True, hot=[] if n_jumps <= bar else None)
            jumps = materialize(doubled.select("via", F.col("_next").alias("_to")))
    listed = ways.withColumn("cyclic", F.lit(False))
    if found is not None:
        listed = listed.unionByName(found.withColumn("cyclic", F.lit(True)))
    return listed.where("hop > 0").select(F.col("id").alias(id), "hop", "via", "cyclic")


def _jumped(ways: DataFrame, jumps: DataFrame, reach: int, hot: list[Hot] | None) -> DataFrame:
    """The rows of ``ways`` taken ``reach`` hops further, where they go on."""
    joined = balanced_join(ways, jumps, ["via"], right_unique=True, hot=hot)
    return joined.select("id", (F.col("hop") + reach).alias("hop"), F.col("_to").alias("via"))
