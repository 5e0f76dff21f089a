"""The queries of this subpackage by name, and SQL for those that it can express."""

from ledgerloom.llm import substrings, topk
from ledgerloom.llm.html import op3_html
from ledgerloom.llm.langid import op5_langid
from ledgerloom.llm.media import op7_media
from ledgerloom.llm.mixing import op2_mix
from ledgerloom.llm.packing import op4_packing
from ledgerloom.llm.secrets import op1_secrets
from ledgerloom.llm.simhash import op9_simhash
from ledgerloom.llm.substrings import op8_substrings
from ledgerloom.llm.topk import op10_topk
from ledgerloom.llm.urls import op6_urls

QUERIES = {f.__name__: f for f in (op1_secrets, op2_mix, op3_html, op4_packing, op5_langid, op6_urls, op7_media, op8_substrings, op9_simhash, op10_topk)}
ORACLES = {"op8_substrings": substrings.ORACLE, "op10_topk": topk.ORACLE}
