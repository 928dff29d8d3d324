"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._base import texts

#: Texts of about so many bytes are one block: the unit in which words are made distinct before they are shuffled.
BLOCK_BYTES = 24_000_000


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _blocks(batches):
    """Cut a partition's rows ``doc_id, text, place`` into blocks: (block number, checksum, ids, word counts, codes, words in the order of their codes)."""
    codes: defaultdict[bytes, int] = defaultdict()
    ids, counts, parts, size, check, k = [], [], [], 0, 0, None

    def done():
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return k, check, ids, counts, flat, list(codes)

    codes.default_factory = codes.__len__
    for b in batches:
        if k is None and b.num_rows:
            k = b.column(2)[0].as_py() << 24  # the partition's number
        for at in range(b.num_rows):
            raw = (b.column(1)[at].as_py() or "").encode()
            if ids and size + len(raw) > BLOCK_BYTES:
                yield done()
                ids, counts, parts, size, check, k = [], [], [], 0, 0, k + 1
                codes.clear()
            words = raw.split()
            ids.append(b.column(0)[at].as_py())
            counts.append(len(words))
            parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
            size += len(raw)
            check = zlib.crc32(raw, check)
    if ids:
        yield done()


def word_codes(src: DataFrame) -> DataFrame:
    """Each block's texts as positions in its own word list: rows ``block, check, doc_ids, counts, codes`` for a few texts each."""

    def run(batches):
        import pyarrow as pa

        for k, check, ids, counts, flat, _ in _blocks(batches):
            ends = np.cumsum(counts)
            lo = 0
            while lo < len(ids):
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + 250_000)))
                part = flat[before : ends[hi - 1]]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([k], pa.int64()), "check": pa.array([check], pa.int64()), "doc_ids": pa.array([ids[lo:hi]], pa.list_(id_kind)),
                    "counts": pa.array([counts[lo:hi]], pa.list_(pa.int32())), "codes": pa.array([_pack(part)], pa.binary()),
                })
                lo = hi

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(src.schema["doc_id"].dataType)
    return src.mapInArrow(run, f"block long, check long, doc_ids array<{src.schema['doc_id'].dataType.simpleString()}>, counts array<int>, codes binary")


def distinct_words(src: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct words, dealt by hash: rows ``part, block, check, at, words``; ``at`` are the words' codes in their block."""

    def run(batches):
        for k, check, _, _, _, words in _blocks(batches):
            home = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % parts
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    step = np.diff(own, prepend=0).astype(np.int32)
                    rows.append({"part": p, "block": k, "check": check, "at": _pack(step), "words": zlib.compress(b" ".join([words[i] for i in own]), 1)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("check", pa.int64()), ("at", pa.binary()), ("words", pa.binary())])
    return src.mapInArrow(run, "part int, block long, check long, at binary, words binary")


class WordEncoder:
    """Encodes each distinct word once. Ids are those of the tokenizers library."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.known = most, {}

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        for lo in range(0, len(new), 20_000):
            part = [w.decode() for w in new[lo : lo + 20_000]]
            # Many words as one text with spaces between; the offsets tell which word each id is of.
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            of = np.searchsorted(starts, np.fromiter((o[0] for o in got.offsets), np.int64, len(got)), side="right") - 1
            ids = np.split(np.array(got.ids, np.int32), np.searchsorted(of, np.arange(1, len(part))))
            self.known.update(zip(new[lo : lo + 20_000], ids, strict=True))
        return [self.known[w] for w in words]


def encoded_words(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode the distinct words of each hash part once: rows ``block, check, at, counts, ids``."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, last = WordEncoder(tokenizer_path), None
        for b in batches:
            rows = []
            for row in b.to_pylist():
                if row["part"] != last:
                    encoder.known.clear()
                    last = row["part"]
                got = encoder.encode(zlib.decompress(row["words"]).split(b" "))
                counts = np.array([len(x) for x in got], np.int32)
                rows.append({"block": row["block"], "check": row["check"], "at": row["at"], "counts": _pack(counts), "ids": _pack(np.concatenate(got).astype(np.int32))})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("check", pa.int64()), ("at", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
    return words.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "block long, check long, at binary, counts binary, ids binary")


def id_to_piece(tokenizer_path: str) -> list[str]:
    """The id-to-piece table: as long as the vocabulary, whatever the corpus."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each text and decode the ids again: ``doc_id, n_tokens, ids, decoded``, one row for each input row.

    For a vocabulary whose pre-tokenizer drops white space and whose pieces are decoded with spaces between (no
    decoder in its file). Texts are split into words at ``[\\x20\\x09-\\x0D]``. Each block of texts lists its
    distinct words once; the lists are shuffled by the words' hash, so that each task encodes the distinct words of
    its parts once. The ids are joined back by block and by the words' positions in their texts, and decoded by a
    join of ids with the id-to-piece table, which is as long as the vocabulary. What is shuffled is one code for
    each word of a text and the distinct words of each block; a frequent word costs no more than a rare one.

    ``digests``: instead of ``ids`` and ``decoded``, ``ids_sha256`` (of decimal ids with spaces between) and
    ``decoded_sha256`` (of the decoded text in UTF-8), both lowercase hex.

    The blocks are made twice, for the words and for the codes, so ``docs`` must give the same rows in the same order
    when it is read again, as files do; if it does not, the job stops. Null and empty texts have no ids. Repeated
    rows and null ids are rows like any other, long texts are blocks of their own, an empty table gives an empty
    result, and other columns are not read.
    """
    src = texts(docs, id_col, text_col).withColumn("place", F.spark_partition_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = encoded_words(distinct_words(src, parts), tokenizer_path)
    kind = src.schema["doc_id"].dataType.simpleString()
    # Each block's word lists and texts side by side; rows sort so that the lists come first.
    both = words.select("block", F.lit(0).alias("side"), "check", "at", F.col("counts").alias("word_counts"), "ids", F.lit(None).cast(f"array<{kind}>").alias("doc_ids"), F.lit(None).cast("array<int>").alias("counts"), F.lit(None).cast("binary").alias("codes")).unionByName(
        word_codes(src).select("block", F.lit(1).alias("side"), "check", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("word_counts"), F.lit(None).cast("binary").alias("ids"), "doc_ids", "counts", "codes")
    )
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches):
        import pyarrow as pa

        pieces = np.array([p.encode() for p in id_to_piece(tokenizer_path)], object)
        numbers = np.array([b"%d" % i for i in range(len(pieces))], object)
        block, check, lists, ids_of, said_of, n_of = None, None, [], [], [], None

        def spread():
            """Of each code: its ids, as text, and its pieces; looked up once for each distinct word of the block."""
            size = 1 + max((int(at[-1]) for at, _, _ in lists if len(at)), default=-1)
            ids, said, n = [b""] * size, [b""] * size, np.zeros(size, np.int64)
            for at, counts, flat in lists:
                ends = np.cumsum(counts)
                text, piece = numbers[flat].tolist(), pieces[flat].tolist()
                lo = 0
                for a, hi in zip(at.tolist(), ends.tolist(), strict=True):
                    ids[a], said[a] = b" ".join(text[lo:hi]), b" ".join(piece[lo:hi])
                    lo = hi
                n[at] = counts
            return ids, said, n

        for b in batches:
            for row in b.to_pylist():
                if row["block"] != block:
                    block, check, lists, n_of = row["block"], row["check"], [], None
                if row["check"] != check:
                    raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
                if not row["side"]:
                    lists.append((np.cumsum(_unpack(row["at"], np.int32)), _unpack(row["word_counts"], np.int32), _unpack(row["ids"], np.int32)))
                    continue
                if n_of is None:
                    ids_of, said_of, n_of = spread()
                    lists = []
                codes = _unpack(row["codes"], np.int32)
                ends = np.cumsum(row["counts"])
                n, a, d = [], [], []
                lo = 0
                for hi in ends.tolist():
                    own = codes[lo:hi]
                    own = own[n_of[own] > 0]  # words of characters that the tokenizer drops have no ids
                    n.append(int(n_of[own].sum()))
                    own = own.tolist()
                    ids, said = b" ".join([ids_of[c] for c in own]), b" ".join([said_of[c] for c in own])
                    a.append(hashlib.sha256(ids).hexdigest() if digests else np.array(ids.split(), np.int32))
                    d.append(hashlib.sha256(said).hexdigest() if digests else said.decode())
                    lo = hi
                first = pa.array(a, pa.string() if digests else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(n, pa.int64()), first, pa.array(d, pa.string())], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return both.repartition(parts, "block").sortWithinPartitions("block", "side").mapInArrow(run, f"doc_id {kind}, n_tokens long, {out}")
