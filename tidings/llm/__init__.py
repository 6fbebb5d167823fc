"""Operators of a training-data pipeline: decontamination, language, near copies, packing, mixing, lines,
passages, quality rules, quality classifier, toxicity. Nothing else in the library imports this package."""
