"""Operators over DataFrames: columnar layout, catalogs of schemas, packing and framing facts."""
