"""Operators for preparing training text at scale. Nothing else in the library imports this package.

Shared rules, unless an operator's docstring says otherwise:

- Every operator names its input columns and selects them first, so extra columns of any name are ignored.
- Null identifiers are ordinary values that sort first; repeated rows are rows of their own.
- Operators that number rows and scan twice (line dedup, edited fingerprints, WARC, the pipeline's third stage) number them by
  file and place (``order.Numbered``), which every scan gives alike; a table that is not read from Parquet files is written first.
- An empty table gives an empty result with the same columns.
- Intermediate tables go to the folder in ``spark.checkpoint.dir`` (``gridlens.session.materialize``).
"""
