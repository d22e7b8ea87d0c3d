"""Registered queries by theme."""

from ledgerloom.plans import documents, evaluation, filings, lateral, prose, relational, scalars, stored, streams

REGISTRIES = (relational.registry, documents.registry, evaluation.registry, filings.registry, lateral.registry, prose.registry, scalars.registry, stored.registry, streams.registry)
