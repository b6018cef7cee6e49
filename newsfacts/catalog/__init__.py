"""Registered queries and the SQL that checks them, by section."""
