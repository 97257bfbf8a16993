"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes a stored table of documents and gives the documents that go on, with the same
columns; the last one gives their places in training sequences.

* toxicity: documents that the chain of classifiers calls toxic go.
* exact_dedup: of equal texts the document with the smallest id stays.
* simhash: of each group of near-duplicates the document with the smallest id stays.
* secrets: every secret in a text is replaced by its kind in brackets; all documents stay.
* packing: every document gets its place; nothing is cut off.
"""

import functools
import os

from newstide.llm.common import table
from newstide.llm.exact_dedup import drop_exact_duplicates
from newstide.llm.packing import pack
from newstide.llm.secrets import redact_secrets
from newstide.llm.simhash import drop_near_duplicates
from newstide.llm.toxicity import drop_toxic
from newstide.sources.layout import ensure_shared_dir, remove_table, scratch, written


def toxicity(spark, docs, sf_dir):
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    return drop_exact_duplicates(docs)


def simhash(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


def secrets(spark, docs, sf_dir):
    return redact_secrets(docs, length_col="n_chars")


def packing(spark, docs, sf_dir):
    return pack(docs)


def _stage(stage):
    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        ensure_shared_dir(spark)
        return stage(spark, docs, sf_dir)

    return stage.__name__, run


STAGES = [_stage(stage) for stage in (toxicity, exact_dedup, simhash, secrets, packing)]

# Trained and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Places in training sequences of what is left of ``documents`` after all stages.

    A stage's intermediate tables go when its documents are written, and these when the next stage's
    are; an empty table gives an empty result, null texts and repeated rows are what each operator
    makes of them.
    """
    ensure_shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    last = []
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        for path in last:
            remove_table(spark, path)
        last = [os.path.dirname(one) for one in docs.inputFiles()[:1]]
    return STAGES[-1][1](spark, docs, sf_dir)
