"""Column expressions: vectors, text rules, scores, hashes and array arithmetic."""
