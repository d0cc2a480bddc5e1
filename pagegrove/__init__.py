"""pagegrove: a Spark-native engine that turns tables of crawled web pages
into text for language models (llms.txt documents, page Markdown, link lists).

Every operator is a function from DataFrame(s) to DataFrame; the only Python
executed inside tasks is the Arrow-batched HTML tree builder in
``operators.dom``.
"""

from pagegrove.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
