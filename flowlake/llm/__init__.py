"""Operators of a large-scale text-corpus pipeline.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns DataFrames;
what SQL functions cannot say runs in Arrow batches on the executors.
"""
