"""PySpark-native analytics for hierarchical, citation-linked document collections."""
