"""N-gram Jaccard self-join over prefix trees of globally ordered n-gram sets."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._base import cut, drop_path, may_be_in, texts, written
from ._cluster import components

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct n-gram hashes of texts; a word's hash is computed once while it stays known."""

    def __init__(self, width: int, most: int = 500_000):
        import xxhash

        class Known(dict):
            def __missing__(self, word):
                h = self[word] = xxhash.xxh64_intdigest(word)
                return h

        self.width, self.most, self.known = width, most, Known()

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()  # bytes: only A-Z change
        if len(self.known) > self.most:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = max(0, len(h) - self.width) + 1 if len(h) else 0
        out = np.full(n, min(len(h), self.width), np.uint64)
        for k in range(min(len(h), self.width)):
            out = _mix(out * _C1 + h[k : k + n])
        return np.unique(out)


@functools.cache
def size_classes(num: int, den: int, most: int = 1 << 26, ratio: float = 1.5) -> list[tuple[int, int, int, int, int]]:
    """Classes of set sizes: (least size, largest size, segments, empty segments allowed, orders).

    Two sets that link and of which the larger is in a class differ in at most D = 2 * largest * (den - num) / (den +
    num) n-grams. So with D + 1 segments more than are empty in both, some segment that is not empty is the same in
    both. Without differences (D = 0) the sets are equal, and no segments are needed. Sets with more empty segments
    than allowed are cut again by another order of the n-grams; of those that have too many in all orders, less than
    one in 10^9, each class has one bucket.
    """
    out, lo = [], 1
    while lo <= most:
        hi = max(lo, int(lo * ratio))
        differ = 2 * hi * (den - num) // (den + num)
        slack, odds = 0, 1.0
        if differ:
            least = -(-lo * num // den)
            for s in range(differ + 4):
                m = differ + 1 + s
                mean = m * (1 - 1 / m) ** least  # empty segments
                tail = math.exp(-mean + (s + 1) * (1 + math.log(mean / (s + 1)))) if 0 < mean < s + 1 else float(mean > 0)
                if tail < odds:
                    slack, odds = s, tail
                if odds < 1e-3:
                    break
        orders = min(16, math.ceil(9 / max(0.5, -math.log10(max(odds, 1e-9)))))
        out.append((lo, hi, differ + 1 + slack if differ else 0, slack, orders))
        lo = hi + 1
    return out


def path_segments(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bucket keys of a set: one for each segment of the global order (the order of the hashes) that the set has n-grams in.

    A segment's key stands for exactly the n-grams in it: the piece of the set's path through the tree that lies there.
    """
    keys = []
    n = len(grams)
    for c, (lo, hi, m, slack, orders) in enumerate(size_classes(num, den, 1 << max(26, n.bit_length() + 1))):
        if hi < n or not m:
            continue
        if num * lo > den * n:
            break
        for k in range(orders + 1):
            tag = np.uint64(((c + 1) * 64 + k) * 0x9E3779B97F4A7C15 % 2**64)
            if k == orders:
                keys.append(_mix(np.array([tag])))
                break
            own = np.sort(_mix(grams + tag)) if k else grams
            at = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            keys.append(_mix(_mix(np.add.reduceat(_mix(own + _C1), starts) ^ tag) + at[starts]))
            if m - len(starts) <= slack:
                break
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def trie_links(sets: list[np.ndarray], num: int, den: int):
    """Links (i, j) that connect all sets that are linked by chains of pairs with den * intersection >= num * union.

    The sets in lexicographic order are a prefix tree: sets with a common beginning share the nodes of that path. The
    tree is walked from the root with all sets as probes at once; a node adds its n-grams to the probes' overlaps, for
    all sets under it together. A probe leaves a subtree where its overlap and the n-grams that remain below cannot
    reach what any set there needs.
    """
    size = np.array([len(s) for s in sets])
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    sets, size = [sets[i] for i in order], size[order]
    flat = np.concatenate(sets)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum(size)
    starts = ends - size
    by_gram = np.argsort(code, kind="stable")
    holders = np.repeat(np.arange(len(sets)), size)[by_gram]  # the sets that have each n-gram, by its code
    begin = np.cumsum(count) - count
    codes = [code[a:b] for a, b in zip(starts, ends, strict=True)]

    def met(step):
        """How many of these n-grams each set has."""
        step = step[count[step] > 1]
        n = count[step]
        at = np.arange(n.sum()) + np.repeat(begin[step] - np.cumsum(n) + n, n)
        return np.bincount(holders[at], minlength=len(sets))

    common = []  # length of the common beginning of each set and the next
    for a, b in zip(sets, sets[1:], strict=False):
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        common.append(int(differ[0]) if len(differ) else k)
    common = np.array(common, np.int64)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    need = lambda a, b: -(-num * (a + b) // (num + den))
    stack = [(0, len(sets), 0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
    while stack:
        lo, hi, depth, probes, overlap = stack.pop()
        until = int(common[lo : hi - 1].min()) if hi - lo > 1 else int(size[lo])
        least, most = size[lo:hi].min(), size[lo:hi].max()
        while True:
            reach = overlap + np.minimum(most - depth, size[probes] - overlap)
            alive = (probes < hi - 1) & (reach >= need(size[probes], least))
            probes, overlap = probes[alive], overlap[alive]
            if depth >= until or not len(probes):
                break
            step = codes[lo][depth : min(until, depth + 64)]
            overlap = overlap + met(step)[probes]
            depth += len(step)
        if not len(probes):
            continue
        cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo : hi - 1] == until)).tolist(), hi] if hi - lo > 1 else [lo, hi]
        if hi - lo == 1 or size[lo] == until:  # a set ends here
            for i, o in zip(probes.tolist(), overlap.tolist(), strict=True):
                if i < lo and den * o >= num * (size[i] + size[lo] - o) and (a := find(i)) != (b := find(lo)):
                    root[max(a, b)] = min(a, b)
                    yield order[i], order[lo]
            if hi - lo == 1:
                continue
            cuts = [x for x in cuts if x != lo] if cuts[1] == lo + 1 else [lo + 1, *cuts[1:]]
        stack += [(a, b, depth, probes, overlap) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def digest(grams: np.ndarray) -> int | None:
    """64 bits that stand for a set; null for the empty one."""
    return int(_mix(np.add.reduce(_mix(grams ^ _C2), keepdims=True) + np.uint64(len(grams)))[0].astype(np.int64)) if len(grams) else None


#: The n-grams of the sample are on average this many times those that a set may have alone and still link.
SAMPLE = 1.75
#: Lists of what a large group's lead did not link hold up to ``cap`` times so many n-grams, however many sets that is.
LIST_GRAMS = 2_000
_BYTES = 5  # of an n-gram's hash, to tell which come twice


def sampled_grams(docs: DataFrame, width: int, parts: int, share: float) -> DataFrame:
    """``doc_id, n, ent, part, slice, docs, grams``: two kinds of rows out of rows ``doc_id, text``.

    Without ``part``: each row's set size and digest. With it: n-grams of the first ``share`` of the order, packed for
    each part of them and each slice of a task's sets; ``docs`` has the set's place in the slice. An n-gram that
    several sets of a slice have is sent once, under no set's place. Part -1 is the slice's head: digests, and sizes,
    sampled n-grams and those of them that came again in the slice. Of equal sets in one task the first counts.
    """
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def run(batches):
        import os

        import pyarrow as pa

        shingle, known = Shingler(width), set()
        ents, sizes, own, held = [], [], [], 0

        def dealt():
            place = np.repeat(np.arange(len(ents), dtype=np.uint16), [len(g) for g in own])
            grams, first, code, count = np.unique(np.concatenate(own), return_index=True, return_inverse=True, return_counts=True)
            again = np.bincount(place[count[code] > 1], minlength=len(ents))
            place = np.where(count > 1, 65535, place[first]).astype("<u2")
            grams = _mix(grams ^ _C2)
            part = (grams % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            five = (grams >> np.uint64(64 - 8 * _BYTES))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
            place, ends = place[order], np.cumsum(np.bincount(part, minlength=parts))
            full = np.flatnonzero(np.diff(ends, prepend=0))
            cuts = [(int(ends[k - 1]) if k else 0, int(ends[k])) for k in full.tolist()]
            head = np.array([sizes, [len(g) for g in own], again], "<i8")
            rows = [np.array(ents, "<i8").tobytes(), *(place[a:b].tobytes() for a, b in cuts)], [head.tobytes(), *(five[a:b].tobytes() for a, b in cuts)]
            n = len(cuts) + 1
            slice_ = int.from_bytes(os.urandom(8), "little", signed=True)
            cols = [pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([-1, *full.tolist()], pa.int32()), pa.array([slice_] * n, pa.int64()), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        id_type, names = None, ["doc_id", "n", "ent", "part", "slice", "docs", "grams"]
        for b in batches:
            id_type = b.schema.field(0).type
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                n, ent = [], []
                for raw in part.column(1).cast(pa.binary()).to_pylist():
                    grams = shingle(raw)
                    n.append(len(grams))
                    ent.append(digest(grams))
                    if ent[-1] is not None and ent[-1] not in known:
                        known.add(ent[-1])
                        ents.append(ent[-1])
                        sizes.append(len(grams))
                        own.append(grams[: np.searchsorted(grams, limit, "right")])
                        held += len(own[-1])
                    if len(ents) == 65535 or held > 1_000_000:
                        yield dealt()
                        ents, sizes, own, held = [], [], [], 0
                k = part.num_rows
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ent, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if ents:
            yield dealt()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, ent long, part int, slice long, docs binary, grams binary")


def _by(batches, key: str, rest: tuple[str, ...], done):
    """``done`` of the lists of ``rest``'s values of each run of equal ``key`` in sorted batches."""
    now, rows = None, []
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (key, *rest)]
        for at, *row in zip(*cols, strict=True):
            if at != now and rows:
                yield done(rows)
                rows = []
            now = at
            rows.append(row)
    if rows:
        yield done(rows)


def not_alone(packed: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``ent`` of the sets of :func:`sampled_grams` that may link with another.

    An n-gram that no other set has is in no intersection. So a set of size s with u of them has a similarity of (s - u)
    / s at most, and u is counted over the sample, which is the same n-grams for all sets. No set that links is lost.
    """
    parts = packed.where("part >= 0").select("part", "slice", "docs", "grams")

    def again(batches):
        import pyarrow as pa

        def done(rows):
            g = np.zeros((sum(len(d) for _, d, _ in rows) // 2, 8), np.uint8)
            g[:, :_BYTES] = np.frombuffer(b"".join(g for _, _, g in rows), np.uint8).reshape(-1, _BYTES)
            _, code, count = np.unique(g.view("<u8").ravel(), return_inverse=True, return_counts=True)
            twice, at, out = count[code] > 1, 0, []
            for slice_, d, _ in rows:
                places = np.frombuffer(d, "<u2")
                hit = places[twice[at : at + len(places)] & (places < 65535)]
                at += len(places)
                if len(hit):
                    out.append((slice_, hit.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary()), pa.nulls(len(out), pa.binary())], names=["slice", "docs", "head"])

        yield from _by(batches, "part", ("slice", "docs", "grams"), done)

    def left(batches):
        import pyarrow as pa

        def done(rows):
            ents, head = next((np.frombuffer(d, "<i8"), np.frombuffer(h, "<i8").reshape(3, -1)) for d, h in rows if h is not None)
            more = np.frombuffer(b"".join(d for d, h in rows if h is None), "<u2")
            size, has, met = head
            alone = has - met - np.bincount(more, minlength=len(ents))
            return pa.RecordBatch.from_arrays([pa.array(ents[den * (size - alone) >= num * size], pa.int64())], names=["ent"])

        yield from _by(batches, "slice", ("docs", "head"), done)

    found = parts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(again, "slice long, docs binary, head binary")
    heads = packed.where("part = -1").select("slice", "docs", F.col("grams").alias("head"))
    return heads.unionByName(found).repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(left, "ent long").distinct()


def keyed_sets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``ent, buckets`` of rows ``doc_id, text``: digest and keys, of equal sets in one task once."""

    def run(batches):
        import pyarrow as pa

        shingle, known = Shingler(width), set()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                ent, keys = [], []
                for raw in b.column(1).slice(lo, 1000).cast(pa.binary()).to_pylist():
                    grams = shingle(raw)
                    d = digest(grams)
                    if d is not None and d not in known:
                        known.add(d)
                        ent.append(d)
                        keys.append(path_segments(grams, num, den).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ent, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["ent", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, "ent long, buckets array<long>")


def ngram_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", cap: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: documents linked by n-gram Jaccard similarity, in connected components.

    Texts are lower-cased (A-Z) and split at ``[\\x20\\x09-\\x0D]``; a document's set is its distinct n-grams of
    ``width`` words, or all its words as one n-gram if it has fewer. Two documents link when den * intersection >=
    num * union. ``component_id`` is the smallest id that links lead to, itself included.

    Sets are 64-bit hashes in one global order. Documents with equal sets are one from the start. Sets with too many
    n-grams that no other set has are left out, as nothing can link with them (see :func:`not_alone`). The order is cut
    into so many segments that two sets that link agree on one whole segment; that piece of their paths is the shard
    of the prefix tree where they meet (see :func:`size_classes`). The sets of a shard are walked as a trie with
    pruning by remaining length (:func:`trie_links`), and give no more links than connect them. Shards of more than
    ``cap`` sets are dealt to several lists, first with the shard's lead in each, then all sets that are not yet
    connected to it against all others, so no pair goes unseen. Segments' keys are written to the shared folder, 8 bytes
    for each, until they are grouped, as the shuffle that follows is read twice and could not be shared by two passes
    over the texts.

    Null and empty texts have no set, link with nothing and are components of their own. Repeated rows share a
    component; ties go to the smallest id; a null id takes its component's smallest id. An empty table gives an empty
    result, and other columns are not read. Two distinct sets of the corpus share a 64-bit digest with odds of
    n^2 / 2^65.
    """
    src = texts(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, keepers, some = None, None, src
    # First over a sample of all sets' n-grams, then over all n-grams of those that are left.
    for share in (min(1.0, SAMPLE * max(den - num, den / 50) / den), 1.0):
        packed, packed_path = written(sampled_grams(some, width, 2 * n, share), "sample")
        if own is None:
            own = cut(packed.where("part IS NULL").select("doc_id", "n", "ent"), "own")
            # A class all of whose rows have no id has a null keeper; xxhash64 of null is a number like any other.
            keepers = own.where("ent IS NOT NULL").groupBy("ent").agg(F.min("doc_id").alias("keeper"), F.max("n").alias("n"))
        alive = cut(not_alone(packed, n, num, den), "alive")
        drop_path(docs.sparkSession, packed_path)
        keepers = cut(keepers.join(alive, "ent"), "keepers")
        ids = cut(keepers.select(F.xxhash64("keeper").alias("h")).distinct(), "wanted")
        some = may_be_in(src, F.xxhash64("doc_id"), ids, "near").where("near").select("doc_id", "text")
    keyed, keyed_path = written(keyed_sets(some, width, num, den), "sets")
    sig = keyed.select(F.explode("buckets").alias("bucket"), "ent").join(keepers.select("ent"), "ent", "left_semi")

    def links(batches):
        """Links of rows ``list, ent, text`` that lie together by list. A text under the keeper's id that isn't the ent's is left out."""
        import pyarrow as pa

        now, sets, shingle = None, {}, Shingler(width)

        def done():
            ents = list(sets)
            return [(ents[i], ents[j]) for i, j in trie_links(list(sets.values()), num, den)] if len(ents) > 1 else []

        def batch(out):
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                for at, ent, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if at != now:
                        out += done()
                        now, sets = at, {}
                    grams = shingle(raw)
                    if digest(grams) == ent:
                        sets[ent] = grams
            yield batch(out)
        yield batch(done())

    def verify(lists: DataFrame) -> DataFrame:
        rows = cut(lists.select("list", F.explode("ents").alias("ent")).join(keepers.select("ent", "keeper"), "ent"), "rows")
        ids = cut(rows.select(F.xxhash64("keeper").alias("h")).distinct(), "wanted")
        near = may_be_in(src, F.xxhash64("doc_id"), ids, "near").where("near").select("doc_id", "text")
        # Texts are shuffled, which are shorter than their n-grams' hashes.
        full = near.join(rows, F.col("doc_id").eqNullSafe(F.col("keeper"))).select("list", "ent", "text")
        return full.repartition(n, "list").sortWithinPartitions("list").mapInArrow(links, "a long, b long").distinct()

    labels = components(sig, verify, cap, lambda: drop_path(docs.sparkSession, keyed_path), keepers.select("ent", F.col("n").alias("weight")), cap * LIST_GRAMS)
    labelled = own.join(labels, "ent", "left").withColumn("comp", F.coalesce("comp", "ent"))
    least = labelled.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each component of :func:`ngram_components`, the one of the smallest id; rows without a set or an id stay."""
    gone = ngram_components(docs, id_col=id_col, text_col=text_col, **params).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone_id"), "left_anti")
