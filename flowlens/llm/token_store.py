"""Token-ID output as a content-addressed store: rolling-hash chunks, recipes and Merkle manifests."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._base import cut, drop_path, running_start, texts

#: Ids are stored as unsigned little-endian integers of two bytes, and so must be below this.
WIDTH, LIMIT = "<u2", 1 << 16
#: A byte-level pre-tokenizer always begins a new word at a single space or line feed between two other characters.
#: Texts in which all white space is like that are cut there; others are encoded as they are. In the vocabulary these
#: two characters stand for themselves as follows.
BEGIN = {" ": "\u0120", "\n": "\u010a"}
#: White space that isn't like that, for Arrow's regular expressions: at an end, next to another, or another character of Unicode's.
ODD_SPACE = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct piece once while it stays known.

    A piece is what stands before the first single space or line feed of a text, or one of these with what follows it
    up to the next. Cutting there never changes the ids. A batch's pieces are made distinct, looked up, and its ids
    gathered with Arrow and numpy; new pieces go to the library, a hundred as one text: the ids of each begin at a
    token that begins with the piece's space or line feed, as no other token of the piece has one.
    """

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= LIMIT:
            raise ValueError(f"ids must be below {LIMIT}")
        self.most = most
        # A piece without its space, or with its line feed. When ``known`` is full it becomes ``before``, of which what is needed again goes back.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.begins = {c: np.zeros(LIMIT, bool) for c in BEGIN}
        for token, k in vocabulary.items():
            for c, letter in BEGIN.items():
                self.begins[c][k] = token.startswith(letter)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, WIDTH).tobytes()

    def _learn(self, pieces: list[str], together: int = 100) -> None:
        for c in BEGIN:
            own = [p for p in pieces if (p[0] == "\n") == (c == "\n")]
            groups = [own[lo : lo + together] for lo in range(0, len(own), together)]
            for lo in range(0, len(groups), 200):
                some = groups[lo : lo + 200]
                marked = ["".join(g) if c == "\n" else " " + " ".join(g) for g in some]
                for group, encoding in zip(some, self.tokenizer.encode_batch_fast(marked, add_special_tokens=False), strict=True):
                    ids = np.array(encoding.ids, WIDTH)
                    at = 2 * np.flatnonzero(self.begins[c][ids])
                    if len(at) == len(group):
                        data = ids.tobytes()
                        self.known.update(zip(group, [data[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(data)], strict=True)], strict=True))
                    else:
                        self.known.update((p, self._whole(p if c == "\n" else f" {p}")) for p in group)

    def encode(self, column, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column of texts, one after the other, each with ``tail`` behind; and the ends of the texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(column):
            return np.zeros(0, WIDTH), np.zeros(0, np.int64)
        # Texts with other white space than single spaces and line feeds between characters are encoded as they are.
        odd = pc.or_(pc.equal(column, ""), pc.match_substring_regex(column, ODD_SPACE))
        whole = odd.to_numpy(zero_copy_only=False)
        uncut = iter(column.filter(odd).to_pylist())
        column = pc.if_else(odd, "", column)
        # The line feed goes on with its piece.
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        flat = lists.flatten().dictionary_encode()
        # Through numpy, as Arrow's own to_pylist is several times slower.
        codes, pieces = flat.indices.to_numpy(), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        size = pc.list_value_length(lists).to_numpy()
        starts = np.cumsum(size) - size
        if 2 * len(self.known) > self.most:
            self.known, self.before = {}, self.known
        parts = list(map(self.known.get, pieces))
        missing = [k for k, x in enumerate(parts) if x is None]
        new = [pieces[k] for k in missing]
        old = list(map(self.before.get, new))
        self.known.update((p, x) for p, x in zip(new, old, strict=True) if x is not None)
        self._learn([p for p, x in zip(new, old, strict=True) if p and x is None])
        for k, p in zip(missing, new, strict=True):
            parts[k] = self.known.get(p, b"")
        # What stands first in each text: all of it, or the piece before any white space.
        heads = [next(uncut) if w else pieces[k] for k, w in zip(codes[starts].tolist(), whole.tolist(), strict=True)]
        every = len(parts) + np.arange(len(heads))
        parts += [np.array(e.ids, WIDTH).tobytes() for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)]
        parts.append(tail)
        codes = codes.astype(np.int64)
        codes[starts] = every
        codes = np.insert(codes, starts + size, len(parts) - 1)
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        begin = np.cumsum(length) - length
        n = length[codes]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(parts), WIDTH)[np.arange(ends[-1]) + np.repeat(begin[codes] - ends + n, n)]
        return ids, ends[codes == len(parts) - 1]


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each process: a worker that finds this package keeps what it knows from task to task."""
    return PieceEncoder(path)


def boundaries(ids: np.ndarray, ends: np.ndarray, bits: int = 10, window: int = 16, longest: int = 16_384) -> np.ndarray:
    """Ends of the chunks of texts whose ids lie one after the other in ``ids``, up to ``ends``.

    A chunk ends where a rolling hash of the last ``window`` ids has ``bits`` zero bits (never in the first ids of a
    text, so that where a text stands doesn't matter), after ``longest`` ids at most, and at the end of its text.
    """
    every = (np.arange(LIMIT, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    every ^= every >> np.uint64(29)
    rolling = (every * np.uint64(0xBF58476D1CE4E5B9))[ids]
    reach = 1  # the sum over k < reach of the mixed id k places before, shifted by k
    while reach < window:
        rolling[reach:] += rolling[:-reach] << np.uint64(reach)
        reach *= 2
    cut_at = (rolling >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0
    starts = np.concatenate([[0], ends[:-1]])
    for k in range(window - 1):
        cut_at[np.minimum(starts + k, len(ids) - 1)] = False
    cut_at[ends - 1] = True
    out = np.flatnonzero(cut_at) + 1
    begin = np.concatenate([[0], out[:-1]])
    if len(long := np.flatnonzero(out - begin > longest)):
        out = np.union1d(out, np.concatenate([np.arange(begin[i] + longest, out[i], longest) for i in long]))
    return out


class Merkle:
    """Root of the binary hash tree over leaves that come one by one; leaves and inner nodes are told apart by a first byte."""

    def __init__(self):
        self.open: list[bytes | None] = []  # of each level, the node that has no sibling yet
        self.count: list[int] = []

    def add(self, leaf: bytes) -> None:
        self._push(0, hashlib.sha256(b"\0" + leaf).digest())

    def _push(self, k: int, node: bytes) -> None:
        while True:
            if k == len(self.open):
                self.open.append(None)
                self.count.append(0)
            self.count[k] += 1
            if self.open[k] is None:
                self.open[k] = node
                return
            node, self.open[k] = hashlib.sha256(b"\1" + self.open[k] + node).digest(), None
            k += 1

    def root(self) -> bytes:
        """The root; no leaf can be added after it."""
        k = 0
        while self.count and self.count[k] > 1:
            if self.open[k] is not None:
                node, self.open[k] = self.open[k], None
                self._push(k + 1, hashlib.sha256(b"\1" + node).digest())
            k += 1
        return self.open[k] if self.count else hashlib.sha256(b"").digest()


def merkle(leaves) -> bytes:
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


def encode_chunks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``row, doc_id, pos, sha, n, ids``: each text's ids with ``end_id`` behind them, cut into chunks.

    ``row`` tells rows of ``docs`` apart. A task gives the ids of equal chunks once, the others have null.
    """

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        try:
            from flowlens.llm.token_store import piece_encoder as kept
        except ModuleNotFoundError:  # a worker without this package has the function that came with the task
            kept = piece_encoder
        encoder, given = kept(tokenizer_path), set()
        tail = np.array([end_id], WIDTH).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                flow, last = encoder.encode(part.column(1), tail)
                data, ends = flow.tobytes(), boundaries(flow, last)
                starts = np.concatenate([[0], ends[:-1]])
                of = np.searchsorted(last, starts, side="right")
                pos = np.arange(len(ends)) - np.searchsorted(of, of)
                ids, shas = [], []
                for i, j in zip((2 * starts).tolist(), (2 * ends).tolist(), strict=True):
                    chunk = data[i:j]
                    sha = hashlib.sha256(chunk).digest()
                    shas.append(sha)
                    ids.append(None if sha in given else chunk)
                    given.add(sha)
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column(2).take(at), part.column(0).take(at), pa.array(pos.astype(np.int32)), pa.array(shas, pa.binary()), pa.array((ends - starts).astype(np.int32)), pa.array(ids, pa.binary())], names=["row", "doc_id", "pos", "sha", "n", "ids"])

    src = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return src.mapInArrow(run, f"row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, pos int, sha binary, n int, ids binary")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the store ``path``.

    ``chunks`` has each distinct chunk of ids once, under its SHA-256. ``recipes`` has for each document, in ascending
    id, its place in the whole stream, its chunks' hashes in order and their Merkle root. ``manifest`` has the Merkle
    root over each range of recipes, and under part -1 the root over those.

    Texts are encoded once; ids are shuffled once, by chunk, to where each chunk is stored. What goes on from there to
    the recipes is hashes. Equal chunks carry their ids once for each task, so a group of copies with a third of all
    rows is shuffled as hashes. Null texts are empty and still get the end id. Null ids come first, rows that repeat
    an id follow each other. An empty table gives an empty store whose manifest has one row. Long texts are many
    chunks. Other columns are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def once(batches):
        """Of the rows of a chunk, which begin with one that has the ids: the chunk as a row of its own, and all as references."""
        import pyarrow as pa
        import pyarrow.compute as pc

        last = None
        for b in batches:
            sha = b.column(3)
            if not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.not_equal(sha.slice(1), sha.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = sha[0].as_py() != last
            last = sha[b.num_rows - 1].as_py()
            kind = pa.array(["ref"] * b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.nulls(b.num_rows, pa.binary()), kind], names=[*b.schema.names, "kind"])
            own = b.filter(pa.array(new))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(["chunk"] * own.num_rows)], names=[*b.schema.names, "kind"])

    encoded = encode_chunks(docs, tokenizer_path, end_id, id_col, text_col)
    dealt = encoded.repartition(n, "sha").sortWithinPartitions("sha", F.col("ids").asc_nulls_last(), "row", "pos")
    both = dealt.mapInArrow(once, f"{encoded._jdf.schema().toDDL()}, kind string")
    both.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/stored")
    kinds = spark.read.schema(f"{encoded._jdf.schema().toDDL()}, kind string").parquet(f"{path}/stored")
    refs = kinds.where("kind = 'ref'").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "sha", "n"))).alias("refs"))
    rows = refs.select("doc_id", F.aggregate("refs", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"), F.col("refs.sha").alias("shas"))

    def rooted(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([merkle(x) for x in b.column(2).to_pylist()], pa.binary())], names=[*b.schema.names, "root"])

    placed = running_start(rows.mapInArrow(rooted, f"{rows._jdf.schema().toDDL()}, root binary"), "doc_id", "n_tokens", "start")
    placed.repartitionByRange(n, "start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")

    ordered = spark.read.parquet(f"{path}/recipes").select("start", "root").repartitionByRange(n, "start").sortWithinPartitions("start")
    ranged = ordered.select(F.spark_partition_id().alias("part"), "start", "root")
    parts = cut(range_roots(ranged), "manifest")
    # One row for each partition of the range exchange: bounded by spark.sql.shuffle.partitions.
    top = merkle([r.root for r in parts.orderBy("first_start").select("root").collect()])
    total = parts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    whole = spark.createDataFrame([(-1, 0, total, bytearray(top))], parts.schema)
    parts.unionByName(whole).coalesce(1).write.parquet(f"{path}/manifest")
    drop_path(spark, f"{path}/stored/kind=ref")


def range_roots(rows: DataFrame) -> DataFrame:
    """``part, first_start, n_docs, root`` of each part of rows ``part, start, root`` that lie sorted in their partitions."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("first_start", pa.int64()), ("n_docs", pa.int64()), ("root", pa.binary())])
        now, first, count, tree = None, None, 0, Merkle()
        for b in batches:
            for part, start, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([{"part": now, "first_start": first, "n_docs": count, "root": tree.root()}], schema=schema)
                    now, first, count, tree = part, start, 0, Merkle()
                tree.add(root)
                count += 1
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"part": now, "first_start": first, "n_docs": count, "root": tree.root()}], schema=schema)

    return rows.mapInArrow(run, "part int, first_start long, n_docs long, root binary")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Work out the roots of the recipes' ranges anew and hold them against the manifest; a difference raises an error.

    The driver sees the manifest's rows alone, one for each partition that wrote it. A recipe's hashes are held against
    its own root where its chunks are put together.
    """
    manifest = {r.part: (r.first_start, r.n_docs, bytes(r.root)) for r in spark.read.parquet(f"{path}/manifest").collect()}
    _, total, top = manifest.pop(-1)
    first = sorted((v[0], k) for k, v in manifest.items())
    if merkle([manifest[k][2] for _, k in first]) != top or sum(v[1] for v in manifest.values()) != total:
        raise RuntimeError("the manifest's root is not that of its ranges")

    def placed(batches):
        import pyarrow as pa

        at, number = np.array([x for x, _ in first], np.int64), np.array([k for _, k in first], np.int32)
        for b in batches:
            k = np.searchsorted(at, b.column(0).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(number[k] if len(at) else np.full(b.num_rows, -2, np.int32)), *b.columns], names=["part", *b.schema.names])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.read.parquet(f"{path}/recipes").select("start", "root").mapInArrow(placed, "part int, start long, root binary")
    again = range_roots(rows.repartition(n, "part").sortWithinPartitions("part", "start"))
    if {r.part: (r.first_start, r.n_docs, bytes(r.root)) for r in again.collect()} != manifest:
        raise RuntimeError("the recipes are not those of the manifest")


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``sha, ids`` of each stored chunk. A chunk whose ids don't have the SHA-256 it is stored under stops the job."""
    rows = spark.read.schema("sha binary, ids binary, kind string").parquet(f"{path}/stored").where("kind = 'chunk'")
    wrong = F.raise_error(F.concat(F.lit("chunk "), F.hex("sha"), F.lit(" is damaged")))
    return rows.select("sha", F.when(F.sha2("ids", 256) == F.lower(F.hex("sha")), F.col("ids")).otherwise(wrong).alias("ids"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``root, n_tokens, ids``: each distinct stream of ids, put together again from the store and verified.

    Every chunk must have the SHA-256 it is stored under, every document the Merkle root of its recipe; a failure
    stops the job. Documents with one root are one stream, so copies are put together once.
    """
    verify_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes").select("root", "shas").dropDuplicates(["root"])
    refs = recipes.select("root", F.posexplode("shas").alias("pos", "sha"))
    found = refs.join(stored_chunks(spark, path), "sha", "left")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rebuild(batches):
        import pyarrow as pa

        root, own = None, []

        def whole():
            shas = [hashlib.sha256(c).digest() for c in own]
            if merkle(shas) != root:
                raise RuntimeError(f"document {root.hex()} can't be put together from its chunks")
            data = b"".join(own)
            return {"root": root, "n_tokens": len(data) // np.dtype(WIDTH).itemsize, "ids": data}

        schema = pa.schema([("root", pa.binary()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            out = []
            for r, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r != root:
                    if root is not None:
                        out.append(whole())
                    root, own = r, []
                own.append(ids or b"")
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if root is not None:
            yield pa.RecordBatch.from_pylist([whole()], schema=schema)

    return found.select("root", "pos", "ids").repartition(n, "root").sortWithinPartitions("root", "pos").select("root", "ids").mapInArrow(rebuild, "root binary, n_tokens long, ids binary")


def crc_shifts(bits: int = 40) -> np.ndarray:
    """For each power of two: tables by byte of what that many zero bytes do to a crc32, as :func:`zlib.crc32` counts it."""
    one = np.array([1 << k for k in range(1, 32)], np.uint64)
    step = np.concatenate([[np.uint64(0xEDB88320)], one >> np.uint64(1)])  # one zero bit

    def apply(m, x):
        return functools.reduce(np.bitwise_xor, (np.where((x >> np.uint64(k)) & np.uint64(1), m[k], np.uint64(0)) for k in range(32)))

    for _ in range(3):
        step = apply(step, step)  # one zero byte
    out = []
    for _ in range(bits):
        out.append([apply(step, np.arange(256, dtype=np.uint64) << np.uint64(8 * k)) for k in range(4)])
        step = apply(step, step)
    return np.array(out)


def joined_crc(crcs: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each text from its chunks' crc32 and bytes: chunks lie one after the other, texts end at ``ends``."""
    total = np.cumsum(sizes)
    of = np.searchsorted(ends, np.arange(len(crcs)), side="right")
    after = total[ends - 1][of] - total  # bytes of the text behind each chunk
    x = crcs.astype(np.uint64)
    for k, t in enumerate(crc_shifts()):
        moved = np.flatnonzero((after >> k) & 1)
        y = x[moved]
        x[moved] = t[0][y & np.uint64(255)] ^ t[1][(y >> np.uint64(8)) & np.uint64(255)] ^ t[2][(y >> np.uint64(16)) & np.uint64(255)] ^ t[3][y >> np.uint64(24)]
    return np.bitwise_xor.reduceat(x, np.concatenate([[0], ends[:-1]])) if len(ends) else x


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files: crc32 of its ids as unsigned 32-bit integers.

    The recipes must have the Merkle roots of the manifest (:func:`verify_manifest`); a chunk that is gone stops the job.
    Each stored chunk is read and held against its SHA-256, and its crc32 taken, once. A document's crc32 follows from
    those of its chunks, put together in the order of its recipe, which must have the recipe's Merkle root; so hashes
    are shuffled, and no ids. (:func:`read_store` puts the ids themselves together.)
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches):
        import pyarrow as pa

        for b in batches:
            wide = [np.frombuffer(x, WIDTH).astype("<u4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in wide], pa.int32()), pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64())], names=["sha", "n", "crc"])

    def whole(batches):
        import pyarrow as pa

        held: list = []  # rows of the stream that may go on in the next batch

        def done(rows):
            if not rows:
                return pa.RecordBatch.from_pydict({"root": pa.array([], pa.binary()), "n_tokens": pa.array([], pa.int64()), "ids_crc32": pa.array([], pa.int64())})
            ends = np.array([k + 1 for k in range(len(rows)) if k + 1 == len(rows) or rows[k + 1][0] != rows[k][0]])
            starts = np.concatenate([[0], ends[:-1]])
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if merkle([r[1] for r in rows[a:b]]) != rows[a][0]:
                    raise RuntimeError(f"document {rows[a][0].hex()} can't be put together from its chunks")
            n_ids = np.array([r[2] for r in rows], np.int64)
            crcs = joined_crc(np.array([r[3] for r in rows], np.uint64), 4 * n_ids, ends)
            return pa.RecordBatch.from_pydict({"root": pa.array([rows[a][0] for a in starts.tolist()], pa.binary()), "n_tokens": pa.array(np.add.reduceat(n_ids, starts)), "ids_crc32": pa.array(crcs.astype(np.int64))})

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            cut_at = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
            if cut_at:
                yield done(held[:cut_at])
                held = held[cut_at:]
        yield done(held)

    verify_manifest(spark, path)
    chunks = stored_chunks(spark, path).mapInArrow(digest, "sha binary, n int, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("root", "shas").dropDuplicates(["root"]).select("root", F.posexplode("shas").alias("pos", "sha"))
    lost = F.raise_error(F.concat(F.lit("chunk "), F.hex("sha"), F.lit(" is not in the store")))
    found = refs.join(chunks, "sha", "left").select("root", "pos", "sha", F.when(F.col("crc").isNull(), lost).otherwise(F.col("n")).alias("n"), "crc")
    rows = found.repartition(n, "root").sortWithinPartitions("root", "pos").select("root", "sha", "n", "crc")
    streams = rows.mapInArrow(whole, "root binary, n_tokens long, ids_crc32 long")
    return recipes.select("doc_id", "start", "root").join(streams, "root", "left").select("doc_id", "start", "n_tokens", "ids_crc32")
