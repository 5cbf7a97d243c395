"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import secret_scan, wand
from .chroma import op8_chroma
from .decontaminate import op7_decontaminate
from .html_blocks import op6_html
from .langid import op10_langid
from .pieces import op9_pieces
from .pii import op3_pii
from .quality import op11_quality
from .secret_scan import op2_secrets
from .simhash import op1_simhash
from .substrings import op4_substring
from .url_filter import op5_urls
from .wand import op13_wand
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_simhash, op2_secrets, op3_pii, op4_substring, op5_urls, op6_html, op7_decontaminate, op8_chroma, op9_pieces, op10_langid, op11_quality, op12_whitening, op13_wand)}

ORACLE_SQL: dict[str, str] = {"op2_secrets": secret_scan.ORACLE_SQL, "op13_wand": wand.ORACLE_SQL}
