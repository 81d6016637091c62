"""PySpark library for population panels, contact graphs and text corpora."""
