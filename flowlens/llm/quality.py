"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._base import texts

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "marks_per_word", "distinct_share", "wide_share", "words_per_line"]
#: The score may not rise in a feature marked -1 and may not fall in one marked 1.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1}


def statistics(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text in UTF-8: the counts named in ``BASE``, and the features named in ``FEATURES``."""
    n = len(raw)
    base, more = np.zeros((n, len(BASE)), np.int64), np.zeros((n, 7))
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__  # a new word's code is the number of words before it
    words: list[np.ndarray] = []
    for i, b in enumerate(raw):
        split = b.split()
        ids = np.fromiter(map(codes.__getitem__, split), np.int64, len(split))
        words.append(ids)
        c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        spaces = int(c[9:14].sum() + c[32])
        points = int(c[:128].sum() + c[192:].sum())
        lines = [x for x in b.split(b"\n") if x.strip()]
        base[i, :4] = len(split), points - spaces, sum(int(c[s]) for s in SYMBOLS), len(lines) - len(set(lines))
        lower, upper, digits = int(c[97:123].sum()), int(c[65:91].sum()), int(c[48:58].sum())
        marks = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
        more[i] = lower, upper, digits, marks, len(np.unique(ids)), int(c[192:].sum()), len(lines)
    codes.default_factory = None  # it holds the table itself, which would stay until the next full garbage collection
    base[:, 4] = repeated_words(words)
    count = np.maximum(base[:, 0], 1)
    lower, upper, digits, marks, distinct, wide, lines = more.T
    letters = np.maximum(lower + upper + wide, 1)
    points = np.maximum(base[:, 1], 1)
    feats = [np.log1p(base[:, 0]), base[:, 1] / count, base[:, 2] / count, base[:, 3] / np.maximum(lines, 1), base[:, 4] / count, upper / letters, digits / points, marks / count, distinct / count, wide / letters, base[:, 0] / np.maximum(lines, 1)]
    return base, np.column_stack(feats)


def repeated_words(words: list[np.ndarray], width: int = 5) -> np.ndarray:
    """For each text, given as word codes: words inside windows of ``width`` words that its text has twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    if not sizes.sum():
        return out
    all_codes, owner = np.concatenate(words), np.repeat(np.arange(len(words)), sizes)
    starts = np.arange(max(0, len(all_codes) - width + 1))
    starts = starts[owner[starts] == owner[starts + width - 1]] if len(starts) else starts
    key = owner[starts].astype(np.uint64)
    for k in range(width):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + all_codes[starts + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = starts[order[:-1][same]], starts[order[1:][same]]
    true = owner[a] == owner[b]  # equal hashes are compared word by word
    for k in range(width):
        true &= all_codes[a + k] == all_codes[b + k]
    step = np.zeros(len(all_codes) + 1, np.int64)
    found = np.unique(np.concatenate([a[true], b[true]]))
    step[found] += 1
    np.subtract.at(step, found + width, 1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(words)).astype(np.int64)


@dataclass
class Trees:
    """All trees in one set of node arrays. A leaf points to itself; a row goes left where its feature is at or under the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of features: all rows step down all trees at once."""
        if not len(x):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, lam: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for the logistic loss. Splits come from histograms of quantile bins.

    A split on a constrained feature is refused where its leaf values would go the wrong way, and the middle of the
    two values then bounds all leaves below it on either side.
    """
    share = min(max(float(y.mean()) if len(y) else 1.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]) if len(y) else None
    raw = np.full(len(y), bias)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(root := node())
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            k, rows, lo, hi, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and hs >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(-gl / (hl + lam), lo, hi), np.clip(-gr / (hr + lam), lo, hi)
                    gain = -(gl * vl + 0.5 * (hl + lam) * vl**2) - (gr * vr + 0.5 * (hr + lam) * vr**2)
                    v = np.clip(-gs / (hs + lam), lo, hi)
                    gain += gs * v + 0.5 * (hs + lam) * v**2
                    gain[(hl < least) | (hr < least) | (monotone[f] * (vr - vl) < 0)] = -1
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (gain[j], (f, j, vl[j], vr[j]))
            if best[1] is None:
                value[k] = rate * float(np.clip(-gs / (hs + lam), lo, hi))
                raw[rows] += value[k]
                continue
            f, j, vl, vr = best[1]
            feature[k], threshold[k] = f, float(cuts[f][j])
            left[k], right[k] = node(), node()
            goes, mid = binned[rows, f] <= j, (vl + vr) / 2
            bound_l, bound_r = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[int(monotone[f])]
            todo += [(left[k], rows[goes], *bound_l, level + 1), (right[k], rows[~goes], *bound_r, level + 1)]
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), bias, depth)


def _bytes(column) -> list[bytes]:
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts of ``BASE`` and the array ``features``, one row for each row of ``docs``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                base, feats = statistics(_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in base.T), pa.array(list(feats), pa.list_(pa.float64()))], names=["doc_id", *BASE, "features"])

    src = texts(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in BASE)}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **params) -> Trees:
    """Fit the trees on at most ``max_labelled`` labelled documents, those first by a hash of the id.

    The bound makes the broadcast of their ids, and what the driver gets (a few numbers for each), independent of
    the corpus. Labels that are null are left out, of several labels of one id the least counts, of several rows
    with one id one is used. Without labels of both kinds the model is the constant share of good labels, or 1
    without any label.
    """
    sample = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("__label_id"), "quality")
    )
    ids = F.broadcast(sample.select("__label_id"))
    rows = document_statistics(docs.select(id_col, text_col).join(ids, F.col(id_col) == F.col("__label_id"), "left_semi"), id_col, text_col)
    rows = rows.groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(sample), F.col("doc_id") == F.col("__label_id"))
    got = sorted((r.doc_id, r.features, r.quality) for r in rows.select("doc_id", "features", "quality").collect())
    x = np.array([r[1] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r[2] > 0) for r in got]), np.array([MONOTONE.get(f, 0) for f in FEATURES]), **params)


def verdicts(raw: list[bytes], model: Trees, threshold: float, min_words: int, max_repeat_percent: int):
    base, feats = statistics(raw)
    failed = (base[:, 0] < min_words) | (100 * base[:, 4] > max_repeat_percent * base[:, 0])
    score = model.score(feats)
    return base, score, failed, ~failed & (score >= threshold)


def judge(docs: DataFrame, model: Trees, threshold: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and ``score``, one row for each row of ``docs``.

    A text fails the base rule with fewer than ``min_words`` words, or with more than ``max_repeat_percent`` of its
    words in 5-word windows that it has twice. Others are kept if the trees score them at ``threshold`` or more.
    Null and empty texts have no words and fail. Long texts are read whole, repeated rows are judged alike, an empty
    table gives an empty result, other columns are not read. No shuffle: each text is judged by itself.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                base, score, failed, kept = verdicts(_bytes(part.column(1)), model, threshold, min_words, max_repeat_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    src = texts(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`judge` does not keep, all columns as they were."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                raw = [x or b"" for x in _bytes(part.column(part.schema.get_field_index(text_col)))]
                yield part.filter(pa.array(verdicts(raw, model, threshold, min_words, max_repeat_percent)[3]))

    return docs.mapInArrow(run, docs.schema)
