"""Spark-first engine for assistant conversation logs and the notes made from them."""
