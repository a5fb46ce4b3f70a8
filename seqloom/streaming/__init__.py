"""Incremental forms of the mergeable modules."""
