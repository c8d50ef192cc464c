"""Operators for training-data pipelines. Nothing else in the library imports this package.

Functions that run in tasks are pickled by value, so executors need no extra files.
"""

from pyspark import cloudpickle

from rundiff.llm import arrays, byte_tokens, conversations, language, lexical_search, neighbours, ngram_join, online_packing, passages, secret_scan, seq_packing, tokens, vector_dedup, warc

for module in (arrays, byte_tokens, conversations, language, lexical_search, neighbours, ngram_join, online_packing, passages, secret_scan, seq_packing, tokens, vector_dedup, warc):
    cloudpickle.register_pickle_by_value(module)
