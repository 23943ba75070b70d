"""The queries of this subpackage, pN_ for problem N, and the SQL they are compared with."""

from __future__ import annotations

from siftline.llm import boilerplate, encoding, fusion, keyword_pages, near_duplicates, packing, reading_level, term_counts

QUERIES = {
    "p1_found": term_counts.p1_found,
    "p1_counts": term_counts.p1_counts,
    "p1_incremental": term_counts.p1_incremental,
    "p2_found": near_duplicates.p2_found,
    "p2_groups": near_duplicates.p2_groups,
    "p3_found": keyword_pages.p3_found,
    "p3_pages": keyword_pages.p3_pages,
    "p4_found": fusion.p4_found,
    "p4_ranking": fusion.p4_ranking,
    "p5_found": boilerplate.p5_found,
    "p5_main_text": boilerplate.p5_main_text,
    "p6_ids": encoding.p6_ids,
    "p7_packing": packing.p7_packing,
    "p7_check": packing.p7_check,
    "p8_found": reading_level.p8_found,
    "p8_levels": reading_level.p8_levels,
}

SQL: dict[str, str] = term_counts.SQL | near_duplicates.SQL | fusion.SQL | packing.SQL
