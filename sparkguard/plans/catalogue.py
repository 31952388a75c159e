"""Importing this module fills the registry."""

from sparkguard.plans import (  # noqa: F401
    audit_queries,
    masking_queries,
    metrics_queries,
    relation_queries,
    replica_queries,
    sync_queries,
    table_queries,
)
