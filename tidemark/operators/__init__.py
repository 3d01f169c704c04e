"""Signals, returns, drawdowns, trades and chart tables."""
