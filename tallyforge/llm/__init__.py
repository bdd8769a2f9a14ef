"""Corpus operators for training data: dedup, decontamination, packing, scoring, token files.

Nothing outside this subpackage imports it."""
