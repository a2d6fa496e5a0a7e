"""The registered queries of this folder, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers

from trackframe.llm import (
    conversation_repair, decontamination, fingerprints, licenses, lm_scoring, ngram_join, packing, pii, substring_dedup,
    token_counts, token_files, toxicity, whitening)
from trackframe.llm.texts import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op5_token_counts")
def op5(spark, d):
    return token_counts.token_counts(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_packing")
def op7(spark, d):
    return packing.packed(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_ngram_join", r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as sh from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by all),
met as (select l.doc_id as a, r.doc_id as b, count(*) as c from s l join s r using (sh) where l.doc_id < r.doc_id group by all),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
ways as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, b as other from ways union select doc_id, b from reach join ways on other = a)
select doc_id, coalesce(any_value(n), 0) as n_shingles, least(doc_id, coalesce(min(other), doc_id)) as component_id
from documents left join n using (doc_id) left join reach using (doc_id) group by doc_id""")
def op4(spark, d):
    return ngram_join.jaccard_components(table(spark, d, "documents"), words=4, num=85, den=100)


@query("op6_toxicity")
def op6(spark, d):
    return toxicity.severities(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op10_fingerprints")
def op10(spark, d):
    return fingerprints.fingerprints(table(spark, d, "documents"))


@query("op9_license_scan")
def op9(spark, d):
    return licenses.license_scan(table(spark, d, "documents"))


@query("op8_personal_data")
def op8(spark, d):
    return pii.personal_data(table(spark, d, "documents"))


@query("op2_decontamination")
def op2(spark, d):
    return decontamination.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op3_substring_dedup")
def op3(spark, d):
    return substring_dedup.without_repeats(table(spark, d, "documents"))


@query("op1_lm_scoring")
def op1(spark, d):
    return lm_scoring.scores(table(spark, d, "documents"))


@query("op11_conversation_repair")
def op11(spark, d):
    return conversation_repair.repairs(conversation_repair.damaged(table(spark, d, "conversations")))


@query("op12_token_files")
def op12(spark, d):
    return token_files.token_ids(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_whitening")
def op13(spark, d):
    return whitening.whitened(table(spark, d, "embeddings"))


@query("pipeline")
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
