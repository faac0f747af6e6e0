"""Every registered query: a Spark function of (spark, sf_dir) and, where SQL can say it, its oracle."""

from __future__ import annotations

from tallyhouse.plans import categories, changes, curation, desk, details, documents, engagement, feeds, hoods, ledger, lists, live, outputs, places, reading, registry, reports, sourced, states, texts, trade, weekly
from tallyhouse.plans.base import Registered

QUERIES: dict[str, Registered] = {}
for module in (engagement, trade, texts, reading, states, curation, ledger, outputs, feeds, reports, registry, details, categories, live, sourced, documents, changes, hoods, lists, weekly, desk, places):
    QUERIES |= module.QUERIES
