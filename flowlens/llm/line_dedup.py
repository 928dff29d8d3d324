"""Fuzzy line dedup by MinHash: character shingles, banding, exact Jaccard, union-find. SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ._base import SPACE_RE, cut, drop_path, may_be_in, texts, written
from ._cluster import bucket_members, connected, with_components


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` has it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(text: Column) -> Column:
    """The lines of a text: what lies between line feeds."""
    return F.split(text, "\n", -1)


def folded(line: Column) -> Column:
    """Lines are compared in lower case, without white space at the ends and with one space for each run of it inside."""
    # Most lines have single spaces alone, which is told much faster than the pattern replaces.
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.btrim(F.lower(F.when(odd, F.regexp_replace(line, f"{SPACE_RE}+", " ")).otherwise(line)))


def wide(line: Column) -> Column:
    """A line with four bytes for each character, so that a shingle is found by its place."""
    return F.encode(line, "UTF-32")


def shingle(wide_line: Column, place: Column, width: int) -> Column:
    """Hash of the character shingle at ``place``, from 0; of a shorter line, of all of it."""
    return F.xxhash64(F.substring(wide_line, place * 4 + 1, F.lit(4 * width)))


def places(line: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.length(line) - width, F.lit(0)))


def shingles(line: Column, width: int) -> Column:
    """All distinct shingles of a line."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(line) - width, F.lit(0)) * 4 + 1, F.lit(4))
    return F.array_distinct(let(wide(line), lambda w: F.transform(starts, lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * width))))))


def banding(num: int, den: int, miss: float = 0.01, most: int = 12) -> tuple[int, int]:
    """(bands, rows of a band): as many rows as ``most`` bands allow, so that at most ``miss`` of the pairs at ``num`` / ``den`` share no band.

    Each row is a hash function of its own, so it agrees with the odds of the similarity whether sets are small or large.
    """
    bands = lambda rows: 1 if num >= den else math.ceil(math.log(miss) / math.log(1 - (num / den) ** rows))
    rows = 1
    while rows < 8 and bands(rows + 1) <= most:
        rows += 1
    return bands(rows), rows


def bits_of(hashed: list[Column]) -> Column:
    """Four bits of each hash, side by side in a long; of none, zeros."""
    out = F.lit(0).cast("long")
    for k, h in enumerate(hashed):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.coalesce(h, F.lit(0).cast("long")), 20).bitwiseAND(F.lit(15).cast("long")), 4 * k))
    return out


def most_different(num: int, den: int) -> int:
    """How many of a signature's hashes may have other bits: of two lines at ``num`` / ``den``, more differ with odds under 1 in 10^6."""
    bands, rows = banding(num, den)
    p = max(0.0, 1 - num / den) * 15 / 16
    return math.ceil(bands * rows * p + 5.2 * math.sqrt(bands * rows * p * (1 - p)))


def words(sig: DataFrame, num: int, den: int) -> DataFrame:
    """``ent, kind, w0, ..., v0, ...``: the bits of all bands of a line, and as many bits of each bucket's hash, those of as many bands as fit side by side in a long."""
    bands, rows = banding(num, den)
    each = 64 // (4 * rows)
    placed = lambda c: F.call_function("shiftleft", c, (F.col("band") % each * (4 * rows)).cast("int"))
    of_bucket = F.shiftrightunsigned("bucket", 64 - 4 * rows)
    word = lambda c, k: F.bit_or(F.when(F.col("band").between(k * each, (k + 1) * each - 1), placed(c)).otherwise(F.lit(0).cast("long")))
    ks = range(-(-bands // each))
    return sig.withColumn("kind", kind()).groupBy("ent", "kind").agg(*[word(F.col("bits"), k).alias(f"w{k}") for k in ks], *[word(of_bucket, k).alias(f"v{k}") for k in ks])


def buckets_before(x: list[Column], y: list[Column], bucket: Column, bands: int, rows: int) -> Column:
    """Whether two lines share a bucket of an earlier band than ``bucket``, by the bits of all their buckets (none: zeros)."""
    each, width = 64 // (4 * rows), F.lit((1 << 4 * rows) - 1)
    at = F.shiftright(bucket, 1).bitwiseAND(F.lit(15).cast("long"))
    own = lambda c, b: F.shiftrightunsigned(c, 4 * rows * (b % each)).bitwiseAND(width)
    shared = F.lit(False)
    for b in range(bands - 1):
        v, w = own(x[b // each], b), own(y[b // each], b)
        shared = shared | ((at > b) & (v == w) & (v != 0))
    return shared


def bucket_of(hashed: Column, band: Column, kind: int) -> Column:
    """59 bits of a hash, four of the number of the band (at most 12, see :func:`banding`) and one of the kind of signature."""
    return F.shiftleft(hashed, 5).bitwiseOR(F.shiftleft(band.cast("long"), 1)).bitwiseOR(F.lit(kind).cast("long"))


def kind() -> Column:
    """Of a bucket: 0 if it is from :func:`binned_signatures`, 1 if from :func:`signatures`."""
    return F.col("bucket").bitwiseAND(F.lit(1).cast("long")).cast("int")


def near(x: list[Column], y: list[Column], most: int) -> Column:
    """Whether ``most`` hashes at most have other bits. ``x`` and ``y`` are the longs of two signatures."""
    differ = F.lit(0)
    for v, w in zip(x, y, strict=True):
        d = v.bitwiseXOR(w)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= most


def grams(lines: DataFrame, width: int, *keys: str) -> DataFrame:
    """The columns ``keys`` and ``gram``: a row for each shingle of ``line``, as compiled columns are many times faster than lambdas."""
    # Two selects: what stands beside an explode is worked out anew for each of its rows.
    at = lines.select("line", *keys, wide(F.col("line")).alias("w")).select("w", *keys, F.explode(places(F.col("line"), width)).alias("i"))
    return at.select(*keys, shingle(F.col("w"), F.col("i"), width).alias("gram"))


def size_limits(num: int, den: int) -> tuple[int, int, int]:
    """(least shingles of a line whose shingles are dealt to bins; most of a line that has many hash functions; so many full bins are few).

    Lines between the first two have both signatures. So do longer ones that fill few bins, as they repeat their
    shingles: lines with as many different ones as the first limit over the similarity fill no more, by three deviations.
    """
    n = math.prod(banding(num, den))
    least = n * 5 // 6
    empty, one = math.exp(-least * den / num / n), least * den / num / n
    return least, 2 * least, math.floor(n * (1 - empty) + 3 * math.sqrt(n * (empty - (1 + one) * empty * empty)))


def binned_signatures(lines: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``ent, band, bucket, bits, far, full``: MinHash by one permutation, for lines of many shingles.

    Each shingle's hash picks one of bands * rows bins, and the least of a bin is one row of a band: one update for a
    shingle, not one for each row. A row agrees with the odds of the similarity, or more if both bins are empty; a band
    without a shingle is none. ``full`` counts bins with a shingle, ``far`` tells lines that have no other signature.
    """
    bands, rows = banding(num, den)
    low = F.lit(0xFFFFFFFF)
    dealt = grams(lines, width, "ent", "far").withColumn("x", F.col("gram").bitwiseAND(low) * F.lit(bands).cast("long"))
    dealt = dealt.select("ent", "far", "gram", F.shiftright("x", 32).alias("band"), F.shiftright(F.col("x").bitwiseAND(low) * F.lit(rows).cast("long"), 32).alias("row"))
    least = dealt.groupBy("ent", "far", "band").agg(*[F.min(F.when(F.col("row") == k, F.col("gram"))).alias(f"least{k}") for k in range(rows)])
    own = [F.col(f"least{k}") for k in range(rows)]
    full = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in own), F.lit(0))
    # A hash has its own place among the bins, so it doesn't matter that xxhash64 passes over nulls.
    return least.select("ent", F.col("band").cast("int").alias("band"), bucket_of(F.xxhash64("band", *own), F.col("band"), 0).alias("bucket"), bits_of(own).alias("bits"), "far", full.alias("full"))


def signatures(lines: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``ent, band, bucket, bits, far, full`` as :func:`binned_signatures`: MinHash by one hash function for each row, for lines of few shingles.

    Of each hash function the least value over the line's shingles; ``rows`` of them are a band, and ``bits`` has four
    bits of each. A band has one hash of the shingle, whose rotations are its rows: on sets as small as a line's
    shingles their leading bits order independently.
    """
    bands, rows = banding(num, den)
    turned = lambda h, k: F.shiftleft(h, 12 * k).bitwiseOR(F.shiftrightunsigned(h, 64 - 12 * k)) if k else h
    hashed = grams(lines, width, "ent").select("ent", *[F.xxhash64("gram", F.lit(b)).alias(f"h{b}") for b in range(bands)])
    least = hashed.groupBy("ent").agg(*[F.min(turned(F.col(f"h{b}"), k)).alias(f"least{b * rows + k}") for b in range(bands) for k in range(rows)])
    own = lambda b: [F.col(f"least{b * rows + k}") for k in range(rows)]
    bucket = lambda b: bucket_of(F.xxhash64(F.lit(b), *own(b)), F.lit(b), 1)
    each = F.array(*[F.struct(F.lit(b).alias("band"), bucket(b).alias("bucket"), bits_of(own(b)).alias("bits")) for b in range(bands)])
    return least.select("ent", F.inline(each)).select("ent", "band", "bucket", "bits", F.lit(False).alias("far"), F.lit(rows).alias("full"))


def similar_pairs(pairs: DataFrame, lines: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose lines have den * intersection >= num * union of their shingles: exact, one pair a row."""
    ends = cut(pairs.select(F.col("a").alias("ent")).unionByName(pairs.select(F.col("b").alias("ent"))).distinct(), "ends")
    known = may_be_in(lines, F.col("ent"), ends, "near").where("near").select("ent", "line")
    of = lambda end: known.select(F.col("ent").alias(end), F.col("line").alias(f"line_{end}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    sets = both.select("a", "b", shingles(F.col("line_a"), width).alias("x"), shingles(F.col("line_b"), width).alias("y"))
    return sets.where((den + num) * F.size(F.array_intersect("x", "y")) >= num * (F.size("x") + F.size("y"))).select("a", "b")


def other_pairs(members: DataFrame, sig: DataFrame, labels: DataFrame, num: int, den: int, cap: int) -> DataFrame:
    """``a, b``: all pairs of members of a bucket that aren't connected yet and whose signatures are near.

    One of such a pair is a stray, a member that isn't connected to the bucket's lead. Strays are joined with the
    bucket's members, and the join itself tells pairs, so that only those that are near become rows, each in the first
    bucket that both share. Buckets of more than ``cap`` members are dealt to parts, each held against all strays, so that
    no task has a whole large bucket.
    """
    ws, vs = ([c for c in sig.columns if c[0] == k] for k in "wv")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = with_components(with_components(members.join(sizes, "bucket"), labels, "ent", "own"), labels, "lead", "theirs")
    strays = known.where("own <> theirs").select("bucket").distinct()
    open_ = known.join(strays, "bucket", "left_semi").withColumn("kind", kind()).join(sig, ["ent", "kind"])
    parts = F.ceil(F.col("n") / cap)
    rows = cut(open_.select("bucket", "ent", "own", (F.col("own") != F.col("theirs")).alias("stray"), parts.alias("parts"), F.pmod(F.xxhash64("ent", F.lit(7)), parts).alias("part"), *ws, *vs), "open")
    x = rows.where("stray").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("ent").alias("a"), F.col("own").alias("own_a"), *[F.col(w).alias(f"{w}_a") for w in [*ws, *vs]])
    y = rows.select("bucket", "part", F.col("ent").alias("b"), F.col("own").alias("own_b"), F.col("stray").alias("stray_b"), *[F.col(w).alias(f"{w}_b") for w in [*ws, *vs]])
    once = ~F.col("stray_b") | (F.col("a") < F.col("b"))
    of = lambda end, names: [F.col(f"{c}_{end}") for c in names]
    alike = near(of("a", ws), of("b", ws), most_different(num, den)) & ~buckets_before(of("a", vs), of("b", vs), x["bucket"], *banding(num, den))
    found = x.join(y, (x["bucket"] == y["bucket"]) & (x["part"] == y["part"]) & (F.col("own_a") != F.col("own_b")) & once & alike)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = 5, cap: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, pos, ent`` of each line with a word; ``ent, comp`` of the lines that are similar to others)."""
    src = texts(docs, id_col, text_col)
    split = src.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("pos", "line"))
    said = split.select("doc_id", "pos", folded(F.col("line")).alias("line")).where("line <> ''").withColumn("ent", F.xxhash64("line"))
    occurrences = cut(said.select("doc_id", "pos", "ent"), "occurrences")
    # Distinct lines are shuffled once; all branches read that shuffle.
    once = said.select("ent", "line").dropDuplicates(["ent"])
    least, most, few = size_limits(num, den)
    size = F.length("line") - (width - 1)
    sig = binned_signatures(once.where(size >= least).withColumn("far", size > most), width, num, den).unionByName(signatures(once.where(size <= most), width, num, den))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rest = [c for c in sig.columns if c != "ent"]
    both = once.select("ent", "line", *[none(sig, c) for c in rest], F.lit("line").alias("what")).unionByName(sig.select("ent", none(once, "line"), *rest, F.lit("sig").alias("what")))
    found, path = written(both, "lines", "what")
    lines, sig = found.where("what = 'line'").select("ent", "line"), found.where("what = 'sig'").select("ent", *rest)
    again = cut(sig.where("far").groupBy("ent").agg(F.sum("full").alias("full")).where(F.col("full") <= few).select("ent"), "again")
    if not again.isEmpty():
        sig = sig.unionByName(cut(signatures(may_be_in(lines, F.col("ent"), again, "near").where("near").join(again, "ent", "left_semi"), width, num, den), "sig"))
    members = cut(bucket_members(sig.select("bucket", "ent")), "members")
    ents = cut(members.select("ent").unionByName(members.select(F.col("lead").alias("ent"))).distinct(), "ents")
    sig = cut(words(may_be_in(sig, F.col("ent"), ents, "near").where("near"), num, den), "bits")
    drop_path(docs.sparkSession, f"{path}/what=sig")

    # 1. Each member against the lead of its bucket; bits of the signature tell most lines that share a band by chance.
    most = most_different(num, den)
    ws = [c for c in sig.columns if c.startswith("w")]
    own = lambda end: sig.select(F.col("ent").alias(end), "kind", *[F.col(w).alias(f"{w}_{end}") for w in ws])
    stars = members.select(F.col("lead").alias("a"), F.col("ent").alias("b"), kind().alias("kind")).distinct()
    stars = stars.join(own("b"), ["b", "kind"]).join(own("a"), ["a", "kind"])
    stars = cut(stars.where(near([F.col(f"{w}_a") for w in ws], [F.col(f"{w}_b") for w in ws], most)).select("a", "b").distinct(), "stars")
    links = cut(similar_pairs(stars, lines, width, num, den), "links")
    labels = connected(links)
    # 2. In buckets of three and more, what isn't connected to the lead is held against all other members.
    more = cut(other_pairs(members, sig, labels, num, den, cap), "pairs")
    if more.isEmpty():
        return occurrences, labels
    return occurrences, connected(links.unionByName(cut(similar_pairs(more, lines, width, num, den), "links")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed``: which lines of each document repeat an earlier line, exactly or nearly.

    Lines are what lies between line feeds; those without a word are left alone. They are compared in lower case with
    white space folded. Two lines are similar if their sets of ``width`` characters have a Jaccard similarity of
    ``num`` / ``den`` or more. Of each connected component the first line stays (smallest doc_id, null last, then
    position), all others are removed. ``removed`` has their positions in ascending order, from 0.

    Lines that are equal are one from the start. MinHash signatures of the same shingles put similar lines into common
    buckets (see :func:`banding`); long and short lines have signatures of their own kind (see :func:`size_limits`). Each
    line is held against its bucket's first line, by exact Jaccard; what is not connected to it is then held against all
    of the bucket, which is dealt to parts of about ``cap`` lines. Bands find more than 99 of 100 similar pairs, of short
    lines, of one word and of scripts without spaces too; bits of the signature, which differ in far fewer places for
    similar lines, spare most of the exact work (see :func:`most_different`).

    A null text has one empty line. Rows that repeat an id are one document whose lines count once for each row and
    share their fate by position. Very long lines and texts are handled whole. An empty table gives an empty result,
    and other columns are not read.
    """
    lines, labels = line_groups(docs, id_col, text_col, **params)
    of = lines.join(labels, "ent", "left").select("doc_id", "pos", F.coalesce("comp", "ent").alias("comp"))
    first = of.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos")).alias("first"))
    # A line that nothing repeats is its component's first; counting tells before the join back.
    marked = of.join(first, "comp").withColumn("gone", ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    per = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("gone").alias("n_removed"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("pos")))).alias("removed"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    out = ids.join(per.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with the lines that :func:`repeated_lines` names taken out of the text, all other columns as they were."""
    gone = repeated_lines(docs, id_col, text_col, **params).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("removed").alias("__removed"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    lines = pieces(F.col(text_col))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("__id").isNull() & F.col("__removed").isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
