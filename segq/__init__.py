"""segq: segment-level bilingual text processing on Spark DataFrames."""
