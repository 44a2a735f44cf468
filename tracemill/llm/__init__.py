"""Training-data operators: dedup, decontamination, filtering, mixing, token output.

Nothing outside this subpackage imports it.
"""
