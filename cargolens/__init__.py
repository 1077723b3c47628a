"""Foreign-trade analytics on customs microdata, written as Spark DataFrames."""

from cargolens.model import FilterState, TradeTables

__all__ = ["FilterState", "TradeTables"]
