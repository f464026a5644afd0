"""lakemill: a PySpark library for civic open data.

Publication views, entity resolution, claim review, reports and ingest are
expressed as functions from DataFrames to DataFrames.
"""
