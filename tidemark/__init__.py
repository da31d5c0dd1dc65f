"""Behavioural drift between deployments, computed as Spark DataFrame jobs."""

from tidemark.session import ensure_checkpoint_dir, local_session

__all__ = ["ensure_checkpoint_dir", "local_session"]
