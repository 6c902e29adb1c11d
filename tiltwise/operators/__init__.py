"""Operators over DataFrames: transforms, profiles, diagnostics, measures, sampling and weight optimizers."""
