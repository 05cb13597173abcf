"""Queries of the training-text operators, by name: callables of (spark, sf_dir), and SQL where SQL can say the same."""

from __future__ import annotations

from . import canonical, encoding, language, leakage, mixing, scans, sentences, truncation, unify
from .common import table

QUERIES = {
    "p1_found": lambda s, d: language.found(table(s, d, "documents"), table(s, d, "wiki_chunk"), table(s, d, "sentences")),
    "p2_found": lambda s, d: unify.found(*(table(s, d, t) for t in ("resolved", "entity_map", "relation_schema"))),
    "p3_found": lambda s, d: scans.found(table(s, d, "sentences"), table(s, d, "pdf_sources")),
    "p4_found": lambda s, d: sentences.found(table(s, d, "sentences")),
    "p5_found": lambda s, d: canonical.found(table(s, d, "resolved"), table(s, d, "entity_map")),
    "p6_found": lambda s, d: truncation.found(table(s, d, "triples_extracted"), table(s, d, "re_predictions"), table(s, d, "sentences")),
    "p7_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: encoding.found(table(s, d, "documents")),
    "p1_segments": lambda s, d: language.all_segments(table(s, d, "documents"), table(s, d, "wiki_chunk"), table(s, d, "sentences")).drop("label"),
    "p2_unified": lambda s, d: unify.unified(*(table(s, d, t) for t in ("resolved", "entity_map", "relation_schema"))),
    "p3_text": lambda s, d: scans.volume_text(table(s, d, "sentences"), table(s, d, "pdf_sources")),
    "p3_corrections": lambda s, d: scans.corrections(table(s, d, "sentences"), table(s, d, "pdf_sources")),
    "p4_sentences": lambda s, d: sentences.units(table(s, d, "sentences")),
    "p5_unmatched": lambda s, d: canonical.unmatched(table(s, d, "resolved"), table(s, d, "entity_map")),
    "p6_rates": lambda s, d: truncation.rates(table(s, d, "triples_extracted"), table(s, d, "re_predictions"), table(s, d, "sentences")),
    "p7_items": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p9_restored": lambda s, d: encoding.restored(table(s, d, "documents")),
    "p9_summary": lambda s, d: encoding.summary(table(s, d, "documents")),
}

SQL: dict[str, str] = {}
