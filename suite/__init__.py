"""Queries that bind the operators to the test tables, each with the SQL that gives the same result."""

from suite import candle_queries, message_queries, series_queries, stream_queries, table_queries

QUERY_MODULES = [candle_queries, series_queries, message_queries, table_queries, stream_queries]
