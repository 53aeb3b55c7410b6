"""Panel, regime and portfolio analytics expressed as Spark DataFrame plans.

Every public operator takes DataFrames and returns a DataFrame, runs no action
and evaluates all panels, configurations, windows and resamples in one plan.
"""
