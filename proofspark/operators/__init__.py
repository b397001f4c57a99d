"""Operators over readings and sessions, each a DataFrame to DataFrame function."""
