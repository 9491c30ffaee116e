"""The queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from foliolens.llm import canonical, encoding, entities, lookalike, names, packing, scans, sentences, splitting, stuffing


def queries():
    return {
        "p1_found": entities.p1_found,
        "p1_links": entities.p1_links,
        "p2_found": canonical.p2_found,
        "p2_unmatched": canonical.p2_unmatched,
        "p3_found": sentences.p3_found,
        "p3_sentences": sentences.p3_sentences,
        "p4_found": scans.p4_found,
        "p4_texts": scans.p4_texts,
        "p5_found": splitting.p5_found,
        "p5_pieces": splitting.p5_pieces,
        "p6_found": names.p6_found,
        "p6_names": names.p6_names,
        "p7_found": lookalike.p7_found,
        "p7_forms": lookalike.p7_forms,
        "p8_ids": encoding.p8_ids,
        "p9_containers": packing.p9_containers,
        "p10_found": stuffing.p10_found,
        "p10_shapes": stuffing.p10_shapes,
    }


def oracle_sql():
    return {
        "p5_found": splitting.P5_FOUND_SQL,
        "p7_found": lookalike.p7_oracle(),
    }
