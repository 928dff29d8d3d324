"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._base import cut, n_words, running_start

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in ascending code points, null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most`` times its source's size, and the excess is shared again by weight until none is above. Sources
    are ranked by range partitions, and each sharing round is one small aggregate, so the number of sources may grow.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.select(F.col("source").isNull().cast("int").alias("last"), "source", "source_size", F.lit(1).cast("long").alias("one"))
    ranked = running_start(per.select(F.concat(F.col("last").cast("string"), F.coalesce("source", F.lit(""))).alias("key"), "source", "source_size", "one"), "key", "one", "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    got = cut(ranked.select("source", "source_size", w.alias("weight")), "sources")
    cap = F.col("source_size") * most
    total = got.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, -1
    while True:
        full = cap <= F.lit(share) * F.col("weight")
        held, rest, n = got.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("long"))).first()
        n = n or 0
        if n == before or not rest:
            break
        share, before = (total - (held or 0)) / rest, n
    target = F.least(cap.cast("double"), F.lit(float(share)) * F.col("weight"))
    return got.select("source", "source_size", target.alias("target"))


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row, fixed by its id, its source's hash and the seed."""
    x = (ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    for shift in (27, 31):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)) / 2**53


class Pivot:
    """Pivotal rounding of one node: at most one unit stays fractional at any time.

    Of two fractional units with sizes s and t, mass moves so that s * p + t * q stays as it is, in one of the two
    directions, until one of p and q is 0 or 1. The direction is drawn so that each expected probability stays too.
    """

    def __init__(self):
        self.held = None  # (row, size, p) of the unit that is still fractional

    def add(self, row: int, size: int, p: float, u: float):
        """Take a unit in; yields (row, 0 or 1) for those that are decided."""
        if p <= 0 or p >= 1:
            yield row, int(p >= 1)
            return
        if self.held is None:
            self.held = (row, size, p)
            return
        i, s, a = self.held
        up = min((1 - a) * s, p * size)  # words that i may take from the new unit
        down = min(a * s, (1 - p) * size)
        x = up if u * (up + down) < down else -down
        a, p = a + x / s, p - x / size
        self.held = None
        for r, z, q in ((i, s, a), (row, size, p)):
            if q < 1e-9 or q > 1 - 1e-9:
                yield r, int(q > 0.5)
            elif self.held is None:
                self.held = (r, z, q)
            else:  # both stayed fractional by rounding errors alone: settle the smaller one
                yield r, int(q > 0.5)


def _level(df: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level of the tree: rows of a node (``source, node``) in the order of ``ukey`` through a Pivot; ``up`` is null for its residual."""

    def run(batches):
        import pyarrow as pa

        node, pivot, kept = None, Pivot(), None  # kept: the residual's row, of an earlier batch

        def settle(row, q):
            """The residual of a finished node goes up the tree, or is drawn at its root."""
            return row | {"p": q, "up": int(_uniform(np.array([row["ukey"]]), seed + 1)[0] < q) if last else None}

        for b in batches:
            src, nodes, keys, sizes, p = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("source", "node", "ukey", "size", "p"))
            draws = _uniform(np.array(keys, np.int64), seed)
            up: list = [None] * b.num_rows
            more = []
            for r in range(b.num_rows):
                if node != (src[r], nodes[r]):
                    if pivot.held:
                        i, _, q = pivot.held
                        if i < 0:
                            more.append(settle(kept, q))
                        else:
                            p[i], up[i] = q, settle({"ukey": keys[i]}, q)["up"]
                    node, pivot = (src[r], nodes[r]), Pivot()
                for i, v in pivot.add(r, sizes[r], p[r], draws[r]):
                    if i < 0:
                        more.append(kept | {"p": float(v), "up": v})
                    else:
                        p[i], up[i] = float(v), v
            here = list(range(b.num_rows))
            if pivot.held and pivot.held[0] >= 0:  # carry the residual over to the next batch
                i, s, q = pivot.held
                kept = b.slice(i, 1).to_pylist()[0]
                here.remove(i)
                pivot.held = (-1, s, q)
            out = b.set_column(b.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).set_column(b.schema.get_field_index("up"), "up", pa.array(up, pa.int32()))
            yield out.take(pa.array(here, pa.int64()))
            if more:
                yield pa.RecordBatch.from_pylist(more, schema=out.schema)
        if pivot.held:
            yield pa.RecordBatch.from_pylist([settle(kept, pivot.held[2])], schema=out.schema)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "source", "node").sortWithinPartitions("source", "node", "ukey", "doc_id").mapInArrow(run, df.schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 11, leaf_units: int = 4096, fan: int = 64) -> DataFrame:
    """How often the mix takes each document: ``doc_id, size, source, source_size, target, copies, taken``.

    A document's size is its number of words; its expected copies are its source's target by its source's size (see
    :func:`source_targets`), at most ``most``. The whole part is certain. The fraction is rounded by pivotal
    dependent rounding that holds each source's words: a source's units are dealt by a hash of the id to leaves of
    about ``leaf_units``, a leaf leaves one fractional unit at most, ``fan`` nodes at a time hand theirs to the
    level above, and the one that is left at a source's root is drawn. A source's taken words thus differ from its
    target by less than one document. The number of leaves follows the largest source, so that a source with a
    third of all rows is as many tasks' work.

    All draws are hashes of ``seed`` and the id: reruns agree, on any cluster. Rows that repeat id, source and size
    are one unit and share one fate; a null id or source is a value like any other. Null and empty texts have no
    mass: they are taken once where their source has a target or holds nothing but such texts. An empty table gives
    an empty result. Extra columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    units = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    targets = cut(source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Spark joins sides by their size: targets has one row for each source.
    joined = units.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("ratio", ratio)
    heavy = joined.where("size > 0")
    largest = heavy.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    nodes = max(1, -(-largest // leaf_units))
    whole = F.least(F.floor("ratio"), F.lit(most))
    key = F.xxhash64("doc_id", "size")
    level = heavy.select(
        "doc_id", "source", "rows", "size", "source_size", "target", whole.cast("int").alias("whole"), key.alias("ukey"), F.pmod(F.xxhash64(key), F.lit(nodes)).alias("node"),
        (F.col("ratio") - whole).alias("p"), F.lit(None).cast("int").alias("up"),
    ).withColumnRenamed("size", "one").withColumn("size", F.col("one") * F.col("rows"))
    done = []
    depth = 0
    while True:
        out = cut(_level(level, seed + 2 * depth, nodes == 1), "pivot")
        done.append(out.where("up IS NOT NULL"))
        if nodes == 1:
            break
        nodes, depth = -(-nodes // fan), depth + 1
        level = out.where("up IS NULL").withColumn("node", F.floor(F.col("node") / fan))
    chosen = done[0]
    for more in done[1:]:
        chosen = chosen.unionByName(more)
    chosen = chosen.select("doc_id", "source", "rows", F.col("one").alias("size"), "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"))
    empty = joined.where("size = 0").select("doc_id", "source", "rows", "size", "source_size", "target", F.when((F.col("target") > 0) | (F.col("source_size") == 0), 1).otherwise(0).alias("copies"))
    every = chosen.unionByName(empty)
    return every.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rows")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, all columns as they were."""
    plan = mix(docs, id_col, text_col, source_col, **params).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), "copies").withColumnRenamed("copies", "__mix_copies")
    on = F.col(id_col).eqNullSafe(F.col("__mix_id")) & F.col(source_col).eqNullSafe(F.col("__mix_source")) & (n_words(F.col(text_col)) == F.col("__mix_size"))
    taken = docs.join(plan, on).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))))
    return taken.select(*docs.columns)
