"""Registered queries: name -> callable(spark, sf_dir), and the SQL that checks each."""

from . import box_queries, match_queries, report_queries, season_queries, stream_queries, trajectory_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (box_queries, match_queries, report_queries, season_queries, stream_queries, trajectory_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
