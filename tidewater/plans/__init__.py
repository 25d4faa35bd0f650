"""Whole queries: operators put together over the test tables, and the SQL that checks them."""
