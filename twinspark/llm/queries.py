"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import fingerprint, langid, licences, lines, mixing, neardup, pieces, pseudonyms, quality, repeats

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_lines": lines.op2_lines,
    "op3_licences": licences.op3_licences,
    "op4_quality": quality.op4_quality,
    "op5_repeats": repeats.op5_repeats,
    "op6_neardup": neardup.op6_neardup,
    "op7_pseudonyms": pseudonyms.op7_pseudonyms,
    "op8_pieces": pieces.op8_pieces,
    "op9_mixing": mixing.op9_mixing,
    "op10_fingerprints": fingerprint.op10_fingerprints,
}
SQL = {"op3_licences": licences.sql(), "op4_quality": quality.SQL, "op9_mixing": mixing.SQL}
