"""Lazy streams of rows to the caller, decoded one by one."""
