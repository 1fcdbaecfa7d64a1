"""Operators for training-data pipelines: filtering, deduplication, decontamination, tokens, archives, licences."""
