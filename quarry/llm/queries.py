"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quarry.llm import align, bpe, chat, fingerprint, langid, lines, mixing, neardup, packing, quality, repeats, spelling, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_mix": mixing.op2_mix,
    "op3_neardup": neardup.op3_neardup,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_language": langid.op7_language,
    "op8_urls": urls.op8_urls,
    "op9_repeats": repeats.op9_repeats,
    "op10_lines": lines.op10_lines,
    "op11_spelling": spelling.op11_spelling,
    "op12_pack": packing.op12_pack,
    "op13_align": align.op13_align,
}
ORACLE_SQL = {
    "op8_urls": urls.ORACLE,
    "op10_lines": lines.ORACLE,
    "op11_spelling": spelling.ORACLE,
}
