"""claimweave: fuse messy multi-source records into one audited profile per entity, on Spark."""

__version__ = "0.1.0"
