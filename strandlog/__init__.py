"""strandlog: append-only, multi-queue logs as Spark DataFrames."""
