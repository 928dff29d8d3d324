"""Removal of repeated byte strings by suffix arrays: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._base import cut, may_be_in, texts

#: Length of the byte strings that make anchors. A string of ``width`` bytes holds width - GRAM + 1 of them.
GRAM = 32
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial hash: the bytes from i to j hash to (sums[j] - sums[i]) / base^i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(data)), out=out[1:])
    return out


def anchors(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of positions whose strings of ``width`` bytes have one anchor: (hash of the anchor, of the run, first and last position).

    A string's anchor is the leftmost of those of its byte grams whose mixed hash is least. It depends on the string
    alone, so equal strings have their anchors at equal offsets. Strings lie within texts, which end at ``ends``.
    """
    none = np.zeros(0, np.int64)
    nothing = none.astype(np.uint64), none.astype(np.uint64), none, none
    if len(data) < width:
        return nothing
    sums, inverse = _sums(data), _powers(_INV, len(data) - GRAM + 1)
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    # The hash's upper bits, then the place: least is leftmost among equals. Batches are far shorter than 2^26 bytes.
    key = (h & ~np.uint64((1 << 26) - 1)) | np.arange(len(h), dtype=np.uint64)
    span, low, reach = width - GRAM + 1, key, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(key) - span + 1], low[span - reach : span - reach + len(key) - span + 1]) if span > reach else low
    place = (low & np.uint64((1 << 26) - 1)).astype(np.int64)
    fits = np.zeros(len(data) + 1, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= width
    fits[starts[long]] += 1
    fits[ends[long] - width + 1] -= 1
    ok = np.flatnonzero(np.cumsum(fits[: len(place)]) > 0)
    if not len(ok):
        return nothing
    new = np.flatnonzero(np.concatenate([[True], (place[ok][1:] != place[ok][:-1]) | (ok[1:] != ok[:-1] + 1)]))
    last = ok[np.concatenate([new[1:] - 1, [len(ok) - 1]])]
    first, at = ok[new], place[ok[new]]
    # All bytes of the run, with where the anchor stands in them.
    own = (sums[last + width] - sums[first]) * inverse[first] + (at - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[at]
    return h[at], own ^ (own >> np.uint64(29)), first, last


def _pieces(raw: list[bytes], width: int, most: int = 1_000_000):
    """Texts in groups of about ``most`` bytes: (text of each piece, where it begins there, bytes, ends of pieces).

    A longer text is several pieces, each of which goes on for ``width`` - 1 bytes into the next, so every string of
    ``width`` bytes starts in one.
    """
    of, at, parts, size = [], [], [], 0
    for i, x in enumerate(raw):
        for lo in range(0, max(1, len(x) - width + 1), most):
            if size and size + min(most, len(x) - lo) > most:
                yield np.array(of), np.array(at), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                of, at, parts, size = [], [], [], 0
            of.append(i)
            at.append(lo)
            parts.append(x[lo : lo + most + width - 1])
            size += len(parts[-1])
    if parts:
        yield np.array(of), np.array(at), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as a number, zeros behind the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : len(text) + k]
    return out


def suffix_ranks(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of ``text``, sorted by ``width`` bytes at least: equal ranks have equal beginnings.

    Larsson-Sadakane: sort by the first eight bytes, then double what is compared by sorting on the rank of the suffix
    that far ahead. Only groups that are still unsorted are sorted again.
    """
    n = len(text)
    key = _words(text)
    order = np.argsort(key)
    rank = np.full(n + 1, -1)

    def first_of(split):
        """For each place of a sorted run, where its group begins."""
        return np.maximum.accumulate(np.where(split, np.arange(len(split)), 0))

    rank[order] = first_of(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if n else order
    h = 8
    while h < width:
        r = rank[order]
        same = np.concatenate([[False], r[1:] == r[:-1]])
        open_ = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
        if not len(open_):
            break
        own = order[open_]
        key = rank[own] * (n + 1) + rank[np.minimum(own + h, n)] + 1
        again = np.argsort(key)
        own, key = own[again], key[again]
        order[open_] = own
        rank[own] = open_[first_of(np.concatenate([[True], key[1:] != key[:-1]]))]
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix, the length up to ``most`` that it has in common with the one before it in ``order``.

    Kasai: going from a suffix to the next in the text, the common length falls by one at most. All parts of the text
    (``starts`` to ``ends``) are walked at once, each as a lane. Suffixes of one rank agree in ``most`` bytes at least
    and aren't sorted any further, so after such a length a lane begins anew.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    eight = np.concatenate([_words(text), np.zeros(1, np.uint64)])
    tops = [np.uint64(1 << k) for k in range(0, 64, 8)]
    out = np.zeros(n, np.int64)
    h = np.zeros(len(starts), np.int64)
    lanes, step = np.arange(len(starts)), 0
    while len(lanes):
        i = starts[lanes] + step
        j = before[i]
        limit = np.where(j < 0, 0, np.minimum(most, n - np.maximum(i, j)))
        got = np.where(h[lanes] == most, 0, np.maximum(h[lanes] - 1, 0))
        got = np.where(rank[i] == rank[j], limit, np.minimum(got, limit))
        live = np.flatnonzero(got < limit)
        while len(live):
            x = eight[i[live] + got[live]] ^ eight[j[live] + got[live]]
            alike = sum((x < t).astype(np.int64) for t in tops)  # equal bytes of the eight
            got[live] = np.minimum(got[live] + alike, limit[live])
            live = live[(alike == 8) & (got[live] < limit[live])]
        out[i] = got
        h[lanes] = got
        step += 1
        lanes = lanes[starts[lanes] + step < ends[lanes]]
    return out


def found_in(text: np.ndarray, at: np.ndarray, old: np.ndarray, sorted_at: np.ndarray, width: int) -> np.ndarray:
    """Whether the strings at ``at`` are among those of ``old`` at ``sorted_at``, which are in ascending order: binary search."""
    new, eight = _words(text), _words(old)
    steps = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]

    def less(i, j):
        """-1, 0, 1 as old's string at i is less than, equal to or more than the new one at j."""
        out, live = np.zeros(len(i), np.int8), np.arange(len(i))
        for k in steps:
            a, b = eight[i[live] + k], new[j[live] + k]
            out[live] = np.where(a < b, -1, a > b)
            live = live[a == b]
        return out

    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sorted_at))
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        under = less(sorted_at[mid], at[live]) < 0
        lo[live[under]] = mid[under] + 1
        hi[live[~under]] = mid[~under]
    out = lo < len(sorted_at)
    out[out] = less(sorted_at[lo[out]], at[out]) == 0
    return out


def repeats(parts: list[bytes], width: int, seen: list[tuple[np.ndarray, np.ndarray]], own: list[np.ndarray | None] = ()) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of each part, given in ascending order of places: the offsets whose string of ``width`` bytes also starts earlier.

    ``seen``: bytes of earlier blocks with the sorted places of their distinct strings, in which new ones are looked
    up by binary search. Returns also that for this block. ``own``: of each part, None or which of its strings count.
    """
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    starts = ends - size
    text = np.frombuffer(b"".join(parts), np.uint8)
    order, rank = suffix_ranks(text, width)
    # Suffixes with one beginning of ``width`` bytes are neighbours; strings must end within their part.
    group = np.cumsum(common_prefixes(text, order, rank, starts, ends, width)[order] < width)
    whole = np.repeat(ends, size) - np.arange(len(text)) >= width
    for at, mine in zip(starts.tolist(), own, strict=False):
        if mine is not None:
            whole[at : at + len(mine)] &= mine
    whole = whole[order]
    order, group = order[whole], group[whole]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(order) else np.zeros(0, np.int64)
    again = np.zeros(len(text), bool)
    if len(head):
        sizes = np.diff(np.append(head, len(order)))
        again[order] = order > np.repeat(np.minimum.reduceat(order, head), sizes)
        for old, sorted_at in seen:
            again[order[np.repeat(found_in(text, order[head], old, sorted_at, width), sizes)]] = True
    return [np.flatnonzero(again[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], (text, order[head])


def _runs(raw: list[bytes], width: int):
    """The runs of several texts: (text, hash of the anchor, of the run, first and last place in the text)."""
    for of, at, data, ends in _pieces(raw, width):
        value, own, first, last = anchors(data, ends, width)
        piece = np.searchsorted(ends, first, side="right")
        shift = at[piece] - np.concatenate([[0], ends[:-1]])[piece] if len(piece) else piece
        yield of[piece], value, own, first + shift, last + shift


def joined_ranges(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one text each, in ascending order: those that touch put together."""
    if not len(of):
        return of, low, high
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (low[1:] > high[:-1])])
    head = np.flatnonzero(new)
    return of[head], low[head], high[np.append(head[1:] - 1, len(of) - 1)]


def dealt_to(part: bytes, salts: int, width: int) -> np.ndarray:
    """Of each string of a hot anchor's part, which of the anchor's shards it goes to, by a hash of all its bytes."""
    sums = _sums(np.frombuffer(part, np.uint8))
    h = (sums[width:] - sums[:-width]) * _powers(_INV, len(part) - width + 1)
    return (((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(salts)).astype(np.int64)


def salted(part: bytes, low: int, v: int, salts: int, width: int):
    """A part of a hot anchor as several: (shard, where it begins, bytes, shard's number). A shard looks at its own strings only."""
    to = dealt_to(part, salts, width)
    for salt in np.unique(to).tolist():
        at = np.flatnonzero(to == salt)
        shard = (v + (salt + 1) * _B) % 2**64
        yield shard - 2**64 * (shard >= 2**63), low + int(at[0]), part[int(at[0]) : int(at[-1]) + width], salt


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, shard_bytes: int = 500_000, hot_parts: int = 20_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: each text in UTF-8 without the bytes that repeat earlier ones.

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a text of smaller id, or earlier
    in its own text. Strings are judged on the input, matches never cross texts.

    1. Texts that equal an earlier text go whole; their strings need no search.
    2. Every string of ``width`` bytes has an anchor that depends on it alone (see :func:`anchors`). Strings that
       follow each other with one anchor are a run. Hashes of anchors and runs are shuffled by anchor, of equal runs
       in one task only the first. A run that equals an earlier one goes whole; of the others, those whose anchor has
       different runs go on.
    3. Their bytes go to the anchor's shard, so all copies of a string meet in one. An anchor with more than
       ``hot_parts`` runs is several shards, to which its strings are dealt by a hash of all their bytes.
    4. A shard has a suffix array over its parts, and common prefixes tell which strings start earlier. An anchor with
       more than ``shard_bytes`` is cut into blocks with an array each, whose strings are looked up in those of
       earlier blocks by binary search.
    5. The covered bytes are put together by text.

    Null and empty texts, and those of under ``width`` bytes, stay whole. Rows that repeat an id and its text are one
    document; texts under one id come in the order of a hash. Null ids come first. Long texts are handled whole, in
    overlapping pieces; an empty table gives an empty result, and other columns are not read. Two runs pass for equal
    if two hashes of 64 bits agree; among n different runs of one anchor the odds of a wrong match are n^2 / 2^65.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    facts = cut(src.select("doc_id", "dk", F.unhex(F.sha2("text", 256)).alias("sha")).distinct(), "facts")
    owner = facts.groupBy("sha").agg(F.min(F.struct("doc_id", "dk")).alias("first"))
    owners = cut(owner.select(F.col("first.dk").alias("own")), "owners")

    def find(batches):
        """The first of equal runs in a task (``v, run, doc_id, dk, low, high``); and under null, ranges that repeat one here."""
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["v", "run", "doc_id", "dk", "low", "high"]
        for whole in batches:
            rows = pa.Table.from_batches([whole])
            rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("dk", "ascending")], null_placement="at_start"))
            for lo in range(0, len(rows), 2000):
                b = rows.slice(lo, 2000).combine_chunks()
                dks = b["dk"].to_numpy()
                # A row repeated in full is one document.
                b = b.filter(pa.array(np.concatenate([[True], dks[1:] != dks[:-1]])))
                dks, ids = b["dk"].to_numpy(), b["doc_id"].combine_chunks()
                for of, value, own, first, last in _runs(b["text"].cast(pa.binary()).to_pylist(), width):
                    _, head = np.unique(own, return_index=True)
                    sent = np.zeros(len(own), bool)
                    sent[head] = True
                    s = np.flatnonzero(sent)
                    yield pa.RecordBatch.from_arrays([pa.array(value[s].view(np.int64)), pa.array(own[s].view(np.int64)), ids.take(pa.array(of[s])), pa.array(dks[of[s]]), pa.array(first[s].astype(np.int32)), pa.array((last[s] + width).astype(np.int32))], names=names)
                    s = np.flatnonzero(~sent)
                    d, low, high = joined_ranges(of[s], first[s], last[s] + width)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.int64()), ids.take(pa.array(d)), pa.array(dks[d]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=names)

    def again(batches):
        """Of runs sorted by anchor, run and place: repeated ones as ranges, under null; the first ones of anchors with several."""
        import pyarrow as pa

        held, several = None, False  # the last first run, whether its anchor has another before it
        now = [None, None, None]  # hash, text and place of the run that is open

        def rows(v, dk, low, high, null):
            return pa.RecordBatch.from_arrays([pa.nulls(len(v), pa.int64()) if null else pa.array(v), pa.array(dk), pa.array(low), pa.array(high)], names=["v", "dk", "low", "high"])

        for b in batches:
            if not b.num_rows:
                continue
            v, run, dk, low, high = (b.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
            new = np.concatenate([[run[0] != now[0]], run[1:] != run[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
            first_dk, first_low = np.where(head < 0, now[1] or 0, dk[head]), np.where(head < 0, now[2] or 0, low[head])
            now = [run[-1], first_dk[-1], first_low[-1]]
            s = np.flatnonzero(~new & ((dk != first_dk) | (low != first_low)))  # the same place again is a repeated row
            yield rows(v[s], dk[s], low[s], high[s], True)
            cols = [x[new] for x in (v, dk, low, high)]
            if held is not None:
                cols = [np.concatenate([h, x]) for h, x in zip(held, cols, strict=True)]
            if len(cols[0]):
                same = cols[0][1:] == cols[0][:-1]
                keep = np.concatenate([[several], same]) | np.concatenate([same, [False]])
                held, several = [x[-1:] for x in cols], bool(keep[-1])
                keep[-1] = False
                yield rows(*(x[keep] for x in cols), False)
        if held is not None and several:
            yield rows(*held, False)

    mine = may_be_in(src, F.col("dk"), owners, "mine").where("mine").select("doc_id", "dk", "text")
    found = mine.mapInArrow(find, f"v long, run long, doc_id {kind}, dk long, low int, high int")
    known = found.where("v IS NULL").select("dk", "low", "high")
    met = found.where("v IS NOT NULL").repartition(n, "v").sortWithinPartitions("v", "run", "doc_id", "dk", "low").mapInArrow(again, "v long, dk long, low int, high int")
    met = cut(known.select(F.lit(None).cast("long").alias("v"), "dk", "low", "high").unionByName(met), "runs")
    firsts = met.where("v IS NOT NULL")
    hot = firsts.groupBy("v").count().where(F.col("count") > hot_parts).select("v", F.ceil(F.col("count") / hot_parts).alias("salts"))
    wanted = cut(firsts.join(hot, "v", "left").groupBy("dk").agg(F.collect_list(F.struct("v", "low", "high", F.coalesce("salts", F.lit(1)).alias("salts"))).alias("runs")).withColumnRenamed("dk", "__dk"), "wanted")

    def surround(batches):
        """Rows ``v, doc_id, dk, low, part, salts, salt``: the bytes of runs, from ``low`` on, and which strings of a hot anchor count."""
        import pyarrow as pa

        def batch(out):
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), id_type, pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["v", "doc_id", "dk", "low", "part", "salts", "salt"])

        for b in batches:
            id_type, out = b.schema.field(0).type, []
            for k in range(b.num_rows):
                doc, dk, raw, runs = (b.column(c)[k] for c in range(4))
                doc, dk, raw = doc.as_py(), dk.as_py(), raw.as_py().encode()
                for r in runs.as_py():
                    part = raw[r["low"] : r["high"]]
                    if r["salts"] == 1:
                        out.append((r["v"], doc, dk, r["low"], part, 1, 0))
                    else:
                        out += ((v, doc, dk, low, x, r["salts"], salt) for v, low, x, salt in salted(part, r["low"], r["v"], r["salts"], width))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def shard(batches):
        """Rows ``dk, low, high``: ranges of bytes that repeat earlier ones."""
        import pyarrow as pa

        held, size, seen = [], 0, []  # seen: earlier blocks of the anchor that is open
        last = None  # anchor, text and place of the row before
        out = []

        def done(rows, old):
            mine = [None if r[4] == 1 else dealt_to(r[3], r[4], width) == r[5] for r in rows]
            got, own = repeats([r[3] for r in rows], width, old, mine)
            for r, at in zip(rows, got, strict=True):
                if len(at):
                    breaks = np.flatnonzero(np.diff(at) > 1)
                    for a, z in zip(at[np.concatenate([[0], breaks + 1])].tolist(), at[np.concatenate([breaks, [len(at) - 1]])].tolist(), strict=True):
                        out.append((r[1], r[2] + a, r[2] + z + width))
            return own

        def batch():
            nonlocal out
            b = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["dk", "low", "high"])
            out = []
            return b

        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), *(b.column(k).to_pylist() for k in range(3, 7)), strict=True):
                    if row[:3] == last:
                        continue  # a row of the table repeated in full
                    other = last is None or row[0] != last[0]
                    if size >= shard_bytes and (other or size >= 2 * shard_bytes):
                        own = done(held, seen)
                        # Only the open anchor's strings can come again.
                        seen = [] if other else [*seen, own]
                        held, size = [], 0
                    elif seen and other:
                        done(held, seen)
                        held, size, seen = [], 0, []
                    held.append(row)
                    size += len(row[3])
                    last = row[:3]
            yield batch()
        if held:
            done(held, seen)
        yield batch()

    near = may_be_in(src, F.col("dk"), wanted.select("__dk"), "near").where("near").select("doc_id", "dk", "text")
    near = near.join(wanted, F.col("dk") == F.col("__dk")).select("doc_id", "dk", "text", "runs")
    parts = near.mapInArrow(surround, f"v long, doc_id {kind}, dk long, low int, part binary, salts int, salt int")
    tried = parts.repartition(n, "v").sortWithinPartitions("v", "doc_id", "dk", "low").mapInArrow(shard, "dk long, low int, high int")
    copies = facts.join(owner, "sha").where("dk <> first.dk").select("dk", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(True).alias("copy"))
    ranges = met.where("v IS NULL").select("dk", "low", "high").unionByName(tried).withColumn("copy", F.lit(False)).unionByName(copies)
    marks = ranges.groupBy(F.col("dk").alias("__dk")).agg(F.collect_list(F.when(F.col("low").isNotNull(), F.struct("low", "high"))).alias("ranges"), F.max("copy").alias("copy"))
    marks = cut(marks, "marks")

    def assemble(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for raw, ranges, copy in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                spans = [(0, len(raw))] if copy and len(raw) >= width else []
                for r in sorted((r["low"], r["high"]) for r in ranges or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], r[1]))
                    else:
                        spans.append(r)
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                out.append((len(raw), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    split = may_be_in(src, F.col("dk"), marks.select("__dk"), "near")
    clean = split.where("not near").select("doc_id", "text", F.lit(None).cast("array<struct<low: int, high: int>>").alias("ranges"), F.lit(False).alias("copy"))
    full = split.where("near").join(marks, F.col("dk") == F.col("__dk"), "left").select("doc_id", "text", "ranges", "copy").unionByName(clean)
    return full.mapInArrow(assemble, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
