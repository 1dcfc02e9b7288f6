"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common as C
from . import decontam, hmm, langid, licenses, mixing, packing, phrases, search, secrets, simhash, sketches, toxicity, warc

QUERIES = {}
SQL = {"op1_mix_sources": mixing.SQL, "op9_warc_shards": warc.SQL, "op11_collocations": phrases.SQL, "op12_ranked_search": search.SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark, sf):
    return C.read(spark, sf, "documents")


@query
def op1_mix_sources(spark, sf):
    return mixing.mix(documents(spark, sf))


@query
def op2_toxicity(spark, sf):
    return toxicity.toxicity(documents(spark, sf), C.read(spark, sf, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "n_words", F.size("segments").cast("long").alias("n_segments"),
        F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["first"], s["last"])), ",").alias("segments"))


@query
def op3_license_scan(spark, sf):
    return licenses.license_table(documents(spark, sf))


@query
def op4_secret_scan(spark, sf):
    return secrets.secret_table(documents(spark, sf))


@query
def op5_simhash_near_dup(spark, sf):
    return simhash.near_duplicates(documents(spark, sf))


@query
def op6_decontaminate(spark, sf):
    return decontam.leaks(documents(spark, sf), C.read(spark, sf, "benchmark"))


@query
def op7_language_id(spark, sf):
    return langid.identified(documents(spark, sf))


@query
def op8_sketches(spark, sf):
    return sketches.edit_table(documents(spark, sf))


@query
def op9_warc_shards(spark, sf):
    return warc.archive(C.read(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_hmm_scores(spark, sf):
    return hmm.scores(documents(spark, sf), F.coalesce(C.crc_mod("doc_id", 7) == 2, F.lit(False)))


@query
def op11_collocations(spark, sf):
    return phrases.collocations(documents(spark, sf))


@query
def op12_ranked_search(spark, sf):
    return search.ranked(documents(spark, sf), C.read(spark, sf, "benchmark"))


@query
def op13_pack(spark, sf):
    return packing.packed(documents(spark, sf))
