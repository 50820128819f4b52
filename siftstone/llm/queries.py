"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from siftstone.llm import encodings, groups, history, leaks, packing, sentences, survivors

QUERIES = {
    "p1_found": groups.p1_found,
    "p3_found": history.p3_found,
    "p4_found": survivors.p4_found,
    "p5_found": encodings.p5_found,
    "p6_pack": packing.p6_pack,
    "p6_fill": packing.p6_fill,
    "p7_found": leaks.p7_found,
    "p8_found": sentences.p8_found,
}

ORACLE_SQL = {
    "p1_found": groups.P1_SQL,
    "p3_found": history.P3_SQL,
    "p4_found": survivors.P4_SQL,
}
