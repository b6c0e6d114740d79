"""Datalog over DataFrames: rules to joins, strata to fixpoints."""
