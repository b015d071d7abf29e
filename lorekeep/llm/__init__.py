"""Corpus preparation: exact and near dedup, decontamination, quality, mixing, token files, archives, licences.

Nothing outside this subpackage imports it.
"""
