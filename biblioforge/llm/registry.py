"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, html_extract, lexical, lm_score, negatives, neighbours, packing, quality, simhash, suffix_dedup, topk, toxicity, warc

_MODULES = (toxicity, warc, lm_score, quality, html_extract, suffix_dedup, packing, simhash, topk, bpe, lexical, neighbours, negatives)

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in getattr(m, "ORACLES", {}).items()}
