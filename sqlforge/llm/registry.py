"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from . import bitsliced, html_text, merkle, mixing, packing, quality, ranked, rules, secrets, sharding, simhash, token_store, toxicity

_MODULES = (sharding, bitsliced, secrets, token_store, quality, toxicity, packing, mixing, simhash, html_text, rules, merkle, ranked)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
