"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; ``textloom.llm.queries`` registers its named queries."""
