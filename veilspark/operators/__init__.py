"""Operators of the engine: detection, token store, reports, risk, audit, nested values."""
