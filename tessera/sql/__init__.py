"""The dialect's SELECT grammar: text to a tree (``parser``), the tree to Spark SQL (``emit``, ``calls``)."""
