"""Training-data operators. Nothing outside this package, its tests, corpus_pipeline.py and the guarded
import in __spark_entry__.py uses them."""
