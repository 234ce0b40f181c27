"""Operators for building training data: output, packing, counting, mixing,
search, near-duplicate joins, language-model scores, HTML extraction, sharding
and quality rules. Nothing outside this subpackage imports it."""
