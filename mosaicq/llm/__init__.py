"""Operators for building training corpora: output, decontamination, de-duplication, scoring, mixing, search.

Nothing outside this subpackage imports it.
"""
