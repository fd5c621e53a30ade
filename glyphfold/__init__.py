"""Positioned-text redaction and validation as Spark DataFrame jobs.

Public functions take and return DataFrames or Columns.  Failures of single
rows are data (an outcome or reason column); they never fail the job.
"""
