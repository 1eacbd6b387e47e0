"""Customer and order analytics for online stores, written as Spark jobs.

Every operation takes and returns DataFrames and works on tables of keys.  See
README.md for a tour; the sub-packages are

``functions``  column expressions (masking, slugs, field names, export cells)
``sources``    readers and writers (landed JSON, CSV, registry, run states)
``operators``  joins, windows, nesting and filters
``plans``      whole jobs built from the operators (export, search, publish)
``streaming``  resumable feeds on Structured Streaming
``suite``      the registered queries and the SQL they are checked against
"""
