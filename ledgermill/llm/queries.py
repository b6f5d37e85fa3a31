"""Queries of the training-data operators."""
from . import decontam, htmltext, langid, licenses, mixing, neighbours, pii, quality, simhash, urlrules
from .common import table

QUERIES = {
    "op1_pii": lambda s, d: pii.find_pii(table(s, d, "documents")),
    "op2_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
    "op3_urls": lambda s, d: urlrules.judge(table(s, d, "pages")),
    "op4_quality": lambda s, d: quality.score(table(s, d, "documents"), table(s, d, "labels")),
    "op5_html": lambda s, d: htmltext.main_text(table(s, d, "pages")),
    "op6_langid": lambda s, d: langid.identify(table(s, d, "documents")),
    "op7_neighbours": lambda s, d: neighbours.search(table(s, d, "embeddings")),
    "op8_decontam": lambda s, d: decontam.contamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op9_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
    "op10_licenses": lambda s, d: licenses.licenses(table(s, d, "documents")),
}
ORACLE_SQL = {"op3_urls": urlrules.ORACLE_SQL}
