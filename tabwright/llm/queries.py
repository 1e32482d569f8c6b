"""All queries of the subpackage; importing the operators registers them."""

from __future__ import annotations

from tabwright.llm import decontaminate, idcoder, licenses, lines, neardup, ngramjoin, packing, phrases, repeats, resample, shards, topk, toxicity  # noqa: F401
from tabwright.llm.registry import ORACLES, QUERIES  # noqa: F401
