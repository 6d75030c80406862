"""A corpus in five stages: every stage reads the documents that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` writes every stage's rows as Parquet to the shared folder and reads them again as the next
one's documents. All stages but the last return the columns of ``documents``.

Empty tables pass through every stage; columns beyond those of ``documents`` are carried along to the
last stage; rows are judged one by one, so repeated rows fare alike, except that the near-duplicate
stage keeps one row of repeated ids and texts, and one document of each group.
"""

from functools import wraps

import public_tokenizers

from areapanel.llm import compression, factorization, jaccard, packing, secrets
from areapanel.llm.common import table
from areapanel.session import staged, step_folder

#: Not expressed in SQL: fitted models, the library's tokens and best-fit packing.
ORACLE_SQL = None


def toxicity(spark, docs, sf_dir):
    """Documents that the factorization machine calls toxic go."""
    return factorization.keep_clean(docs, factorization.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def quality(spark, docs, sf_dir):
    """Documents that the compression classifier calls bad go."""
    return compression.keep_good(docs, compression.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return jaccard.keep_first(docs, width=5, percent=80)


def secret_scan(spark, docs, sf_dir):
    """Secrets in texts are blanked; all documents stay."""
    return secrets.redact(docs)


def best_fit(spark, docs, sf_dir):
    """Documents as pieces of packed sequences: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _step(function):
    """A stage whose working tables go when the next stage begins: its own result is written by then."""

    @wraps(function)
    def stage(spark, docs, sf_dir):
        with step_folder(spark, "corpus"):
            return function(spark, docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _step(toxicity)),
    ("quality_classifier", _step(quality)),
    ("ngram_jaccard_join", _step(near_duplicates)),
    ("secret_scan", _step(secret_scan)),
    ("best_fit_packing", _step(best_fit)),
]


def run(spark, sf_dir):
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
