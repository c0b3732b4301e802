"""Written tables that cut lineage; see corvata.sources.spool."""

from corvata.sources.spool import discard, scratch, shared_dir, spool

__all__ = ["discard", "scratch", "shared_dir", "spool"]
