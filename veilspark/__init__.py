"""Sensitive-text analytics on Spark DataFrames.

Documents become pages, chunks and typed character spans; detection generates
spans, and everything after it is interval algebra and aggregation over
(doc_id, page, start, end, entity_type, confidence).
"""
