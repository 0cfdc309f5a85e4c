"""Scalar functions as column expressions; nothing here runs Python on executors."""
