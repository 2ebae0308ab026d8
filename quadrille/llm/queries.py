"""Queries of the language-model data operators."""

from __future__ import annotations

from . import docpairs, leaks, licenses, origin, parse_errors, pii, prose, tokens

QUERIES = {
    "p2_found": parse_errors.p2_found,
    "p2_rates": parse_errors.p2_rates,
    "p3_found": prose.p3_found,
    "p3_shares": prose.p3_shares,
    "p3_passages": prose.p3_passages,
    "p3_attributes": prose.p3_attributes,
    "p3_attribute_shares": prose.p3_attribute_shares,
    "p4_found": origin.p4_found,
    "p4_kinds": origin.p4_kinds,
    "p5_found": docpairs.p5_found,
    "p5_pairs": docpairs.p5_pairs,
    "p6_found": licenses.p6_found,
    "p6_packages": licenses.p6_packages,
    "p6_directories": licenses.p6_directories,
    "p8_ids": tokens.p8_ids,
    "p8_counts": tokens.p8_counts,
    "p9_found": leaks.p9_found,
    "p9_clean": leaks.p9_clean,
    "p10_found": pii.p10_found,
    "p10_redacted": pii.p10_redacted,
}
#: Words of a text in SQL, as ``leaks.words_of`` gives them.
_WORDS = r"""[trim(x, '_') for x in regexp_extract_all(lower(regexp_replace(regexp_replace(text, '[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E007F}]', '', 'g'), '(?s)<!--.*?-->|</?[A-Za-z][^<>\n]{0,300}>|&(?:[a-zA-Z]{2,8}|#[0-9]{1,6}|#x[0-9a-fA-F]{1,6});|\]\([^()\s]*\)', ' ', 'g')), '[\p{L}\p{N}_]+') if trim(x, '_') <> '']"""


def _grams(table: str, key: str) -> str:
    return f"SELECT {key}, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, len(w) - 8)]) AS g FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL)"


ORACLE: dict[str, str] = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) d JOIN ({_grams('eval_item', 'item_id')}) i USING (g)",
}
