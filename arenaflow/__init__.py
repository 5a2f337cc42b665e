"""Match-telemetry analytics expressed as Spark DataFrame operators.

Every operator takes DataFrames keyed by ``extraction_id`` and returns a
DataFrame, so one job answers for all matches; one match is a filter.
"""
