"""Registered queries and their SQL, by kind."""

from strandlens.plans import counting, designs, extents, ingest, quotas, rulework, working

PLANS = [counting, working, designs, ingest, rulework, extents, quotas]
