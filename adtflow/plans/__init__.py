"""Schemas as plans: the schema language, the model, its catalog tables and physical layouts."""
