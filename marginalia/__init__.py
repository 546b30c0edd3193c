"""Analytics over a corpus of scholarly articles in XML, as Spark DataFrames."""

__version__ = "0.2.0"
