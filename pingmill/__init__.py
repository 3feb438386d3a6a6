"""Analytics over location pings, written as functions from DataFrame to DataFrame."""
