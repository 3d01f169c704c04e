"""Training-data operators over document and page tables.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
