"""Operators of a training-data pipeline, on DataFrames.

Each module holds one operator with its own general interface; ``queries`` registers one
``opN_<name>`` query per operator over its whole table. Nothing outside this subpackage
(and ``corpus_pipeline``) imports it.
"""
