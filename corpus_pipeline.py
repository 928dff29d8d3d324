"""A training-corpus pipeline out of five operators; each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers

from flowlens.llm._base import cut, table
from flowlens.llm.exact_dedup import keep_first_copies
from flowlens.llm.mixing import mixed_rows
from flowlens.llm.ngram_join import keep_one_of_each
from flowlens.llm.quality import keep_good, train
from flowlens.llm.word_bpe import encode_decode


def quality_stage(spark, docs, sf_dir):
    """Documents that fail the base rule or that the trees reject go."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark, docs, sf_dir):
    """Of equal texts one stays."""
    return keep_first_copies(docs)


def near_stage(spark, docs, sf_dir):
    """Of each group of documents linked by 5-word shingles at a Jaccard similarity of 0.8 or more, one stays."""
    return keep_one_of_each(docs, width=5, num=80, den=100)


def mixing_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def bpe_stage(spark, docs, sf_dir):
    """Ids and decoded text of each document of the mix."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]
#: The verdicts of trees and the draws of the mix have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
