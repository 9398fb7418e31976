"""twinweave: find, group and curate duplicate media and corpora with Spark DataFrames."""

__version__ = "0.1.0"
