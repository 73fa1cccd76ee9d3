"""Lossless compression as DataFrame operations: codecs, chunked containers with an index, and the transforms inside them."""
