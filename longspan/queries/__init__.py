"""Thin queries of the library's operators over the driver's tables, each with its SQL."""
