"""Text-localization analytics on Spark: files, strings, glossaries, fragments and patches as DataFrames."""
