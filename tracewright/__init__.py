"""Provenance records as DataFrames: catalog, lineage, audit, Merkle proofs and hand-over on Spark."""
