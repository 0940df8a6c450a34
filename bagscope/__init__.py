"""bagscope: labelled collections of sequence bags, analysed with Spark DataFrames."""

__version__ = "0.1.0"
