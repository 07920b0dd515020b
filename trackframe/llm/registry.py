"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontamination, infill, licenses, mixing, neardup, negatives, pii, quality, secrets, sharding, tokens, topk, warc

MODULES = (mixing, neardup, pii, secrets, warc, tokens, sharding, licenses, quality, decontamination, topk, infill, negatives)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
