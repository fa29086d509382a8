"""Operators for preparing training text and matching extracted evidence; nothing outside imports this package."""
