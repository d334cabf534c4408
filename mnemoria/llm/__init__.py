"""Training-data operators: near-dedup, formatting, decontamination, language ID, secrets, token files, packing, quality, lines.

Nothing outside this subpackage imports it.
"""
