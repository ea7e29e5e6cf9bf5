"""All queries of the library with their SQL oracles."""

from __future__ import annotations

from chronolake.plans import connect, corpora, desk, files, learned, market, memory, more, pit, plugins, records, research, study, vendor
from chronolake.plans.book import ORACLE, QUERIES

FLAGSHIP = QUERIES["a4_strategy_metrics"]

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "connect", "corpora", "desk", "files", "learned", "market", "memory", "more", "pit", "plugins", "records", "research", "study", "vendor"]
