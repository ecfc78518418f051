"""risegraph: learning-uplift analytics over a submissions log, on Spark DataFrames."""

from .params import Params

__all__ = ["Params"]
__version__ = "0.1.0"
