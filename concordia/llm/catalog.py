"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import ann, chat, merkle, minhash, mixing, periods, pieces, quantised, rangecoder, secrets, tokens, toxicity, urls

_MODULES = [minhash, secrets, toxicity, chat, mixing, urls, tokens, ann, pieces, quantised, periods, rangecoder, merkle]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items() if sql}
