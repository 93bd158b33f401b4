"""Genomic variant evidence as Spark DataFrames."""

from genoweave.session import cut_lineage, local_session, shared_folder

__all__ = ["cut_lineage", "local_session", "shared_folder"]
