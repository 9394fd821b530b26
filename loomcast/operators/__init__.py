"""Operators on frames of series, draws and forecasts."""
