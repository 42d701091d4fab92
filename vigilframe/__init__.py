"""vigilframe: security-detection analytics expressed as Spark DataFrame plans.

The package turns platform-neutral detection queries (JSON documents) into lazily built
DataFrames and offers the batch operators around them: rendering, validation, scoring,
coverage audits, retrieval and the flattening of nested query documents.  Operators for
preparing training data live in the optional subpackage ``llm``.
"""

__version__ = "0.1.0"
