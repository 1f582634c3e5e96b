"""behaviorkit: Spark-native behavioural feature and text-classification toolkit.

Sub-packages
------------
sources    table loaders, input views, CSV/TSV/JSON-lines/Parquet readers and sinks
functions  Column-level building blocks (statistics, ratios, text helpers)
operators  DataFrame -> DataFrame operators (features, assembly, encoding, tokens, metrics, models)
plans      registered queries and their DuckDB oracle SQL
llm        training-data operators (dedup, mixing, WARC, quality, packing, token files, LM scores)
"""

from behaviorkit.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
