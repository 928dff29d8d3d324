"""From buckets of possibly similar things to verified links and connected components. SQL functions only.

Members of a bucket are never paired up as rows. They are dealt to lists of bounded length, a verifying function
looks at each list by itself, and it returns links enough to connect what belongs together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ._base import cut


def shared_members(sig: DataFrame) -> DataFrame:
    """``lead, ent`` for all buckets of ``sig`` (``bucket, ent``) that hold two or more different ents: each but the lead, with the lead.

    A bucket's lead is its least ent. Buckets with one lead are one group, so things that share many buckets are in
    few groups. Members are shuffled once, by bucket: where they arrive, an aggregate finds the leads, and a hash join
    with the few buckets of two or more gives their members and drops all others.
    """
    return bucket_members(sig).select("lead", "ent").distinct()


def bucket_members(sig: DataFrame) -> DataFrame:
    """As :func:`shared_members`, with each ``bucket``."""
    n = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark would add these filters to one use of what is dealt out and then shuffle twice.
    dealt = sig.where("bucket IS NOT NULL AND ent IS NOT NULL").select("bucket", "ent").repartition(n, "bucket")
    leads = dealt.groupBy("bucket").agg(F.min("ent").alias("lead"), F.max("ent").alias("last")).where("lead < last").select("bucket", "lead")
    return dealt.join(leads.hint("shuffle_hash"), "bucket").where("ent <> lead").select("bucket", "lead", "ent")


def with_leads(pairs: DataFrame) -> DataFrame:
    """``lead, ent, n``: the members of each group of ``pairs``, its lead among them, with their number."""
    sizes = pairs.groupBy("lead").agg((F.count(F.lit(1)) + 1).alias("n"))
    members = pairs.unionByName(pairs.select("lead", F.col("lead").alias("ent")).distinct())
    return members.join(sizes, "lead")


def _not_covered(lists: DataFrame) -> DataFrame:
    """``lists`` without repeats and without most of those inside a longer one.

    The longest list that holds a member is that member's best. If one other list is the best of all of a list's
    members, it holds them all.
    """
    unique = cut(lists.where(F.size("ents") > 1).select(F.xxhash64("ents").alias("list"), "ents").dropDuplicates(["list"]), "lists")
    rows = unique.select("list", F.size("ents").alias("size"), F.explode("ents").alias("ent"))
    best = rows.groupBy("ent").agg(F.max(F.struct("size", "list")).alias("best"))
    inside = rows.join(best, "ent").groupBy("list").agg(F.min("best.list").alias("a"), F.max("best.list").alias("b")).where("a = b AND a <> list")
    return unique.join(inside.select("list"), "list", "left_anti")


def first_lists(members: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(lists ``list, ents``; the members of groups of more than ``cap``).

    What groups connect in any way is a family. A family of at most ``cap`` members is one list, so each of them
    is looked at once. Larger families go by their groups; a group of more than ``cap`` is dealt to lists of about
    half of that, its lead in each.
    """
    families = connected(members.where("ent <> lead").select(F.col("lead").alias("a"), F.col("ent").alias("b")))
    size = families.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    sized = cut(families.join(size, "comp"), "families")
    small = sized.where(F.col("size") <= cap).groupBy("comp").agg(F.array_sort(F.collect_list("ent")).alias("ents")).select(F.col("comp").alias("list"), "ents")
    rest = members.join(sized.where(F.col("size") > cap).select("ent"), "ent", "left_semi")
    parts = F.when(F.col("n") > cap, F.ceil(F.col("n") / (cap / 2))).otherwise(1)
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("ent", F.lit(7)), parts))
    lists = dealt.groupBy("lead", "part").agg(F.collect_set("ent").alias("ents")).select(F.array_sort(F.array_union("ents", F.array("lead"))).alias("ents"))
    return small.unionByName(_not_covered(lists)), rest.where(F.col("n") > cap)


def with_components(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the component of ``column``, which is itself if nothing is linked to it."""
    of = labels.select(F.col("ent").alias("__ent"), F.col("comp").alias("__comp"))
    return df.join(of, F.col(column) == F.col("__ent"), "left").withColumn(out, F.coalesce("__comp", F.col(column))).drop("__ent", "__comp")


def stray_lists(big: DataFrame, labels: DataFrame, cap: int, key: str = "lead") -> DataFrame:
    """The rest of the large groups (by ``key``): all members that are not yet connected to their lead, with all other members.

    Both are dealt to parts of about half of ``cap`` by ``weight``, and each pair of parts is a list; so every pair of
    which one is a stray is in one list.
    """
    known = with_components(with_components(big, labels, "ent", "own"), labels, "lead", "theirs")
    strays = known.where("own <> theirs").select(key, "ent", "weight")
    parts = lambda df, out: df.groupBy(key).agg(F.ceil(F.sum("weight") / (cap / 2)).alias(out))
    open_ = big.select(key, "ent").join(parts(strays, "s_parts"), key).join(parts(big, "parts"), key)
    home = lambda parts: F.pmod(F.xxhash64("ent", F.lit(7)), F.col(parts))
    all_ = open_.select(key, "ent", home("parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s_parts") - 1)).alias("s_part"))
    odd = open_.join(strays, [key, "ent"], "left_semi").select(key, "ent", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), home("s_parts").alias("s_part"))
    lists = all_.unionByName(odd).groupBy(key, "part", "s_part").agg(F.array_sort(F.collect_set("ent")).alias("ents"))
    return lists.where(F.size("ents") > 1).select(F.xxhash64("ents").alias("list"), "ents").dropDuplicates(["list"])


def connected(links: DataFrame) -> DataFrame:
    """``ent, comp`` for all ends of ``links`` (``a, b``): union-find by contraction.

    In each round a component joins its least neighbour, paths are halved, and links inside components go. Ents
    should be hashes, so that the rounds grow with the logarithm of a component's length. Each round is written to
    the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = cut(both, "edges")
    labels = edges.select(F.col("a").alias("ent")).distinct().withColumn("comp", F.col("ent"))
    while True:
        least = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "least")
        for _ in range(2):
            hop = least.select(F.col("a").alias("mid"), F.col("to").alias("end"))
            least = least.join(hop, F.col("to") == F.col("mid"), "left").select("a", F.coalesce("end", "to").alias("to"))
        least = cut(least, "jump")
        labels = labels.join(least, F.col("comp") == F.col("a"), "left").select("ent", F.coalesce("to", "comp").alias("comp"))
        one, two = least.select("a", F.col("to").alias("c")), least.select(F.col("a").alias("b"), F.col("to").alias("d"))
        labels = cut(labels, "labels")
        edges = cut(edges.join(one, "a").join(two, "b").where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def components(sig: DataFrame, verify: Callable[[DataFrame], DataFrame], cap: int, grouped: Callable[[], None], weights: DataFrame, most: int) -> DataFrame:
    """``ent, comp`` of all ents that are linked. ``verify`` makes links ``a, b`` out of lists ``list, ents``; ``grouped`` is called when ``sig`` is no longer needed.

    First lists hold up to ``cap`` ents, those of strays up to ``most`` by the ents' ``weight`` in ``weights``.
    """
    members = with_leads(cut(shared_members(sig), "shared"))
    grouped()
    lists, big = first_lists(members, cap)
    links = cut(verify(lists), "links")
    labels = connected(links)
    strays = cut(stray_lists(big.join(weights, "ent"), labels, most), "strays")
    if strays.isEmpty():
        return labels
    return connected(links.unionByName(cut(verify(strays), "links")))
