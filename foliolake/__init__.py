"""A document-digitisation analytics engine on Spark: nested page, line and word records as DataFrames."""
