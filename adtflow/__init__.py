"""adtflow: typed-schema analytics on Spark (catalog, codec, converters) and training-data operators."""
