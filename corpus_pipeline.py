"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, mixture."""

from __future__ import annotations

from driftmark.llm import common as C
from driftmark.llm import decontam, langid, mixing, secrets, simhash
from driftmark.session import written


def language(spark, docs, sf_dir):
    """Documents whose language is known and not rejected stay."""
    return langid.accepted(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash component stays."""
    return simhash.deduplicated(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, C.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Every secret found is replaced in its text; all documents stay."""
    return secrets.redacted(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents once per epoch of the mix, cut at the exact budget of their source."""
    return mixing.mixed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]
#: Language models and XXH64 have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
