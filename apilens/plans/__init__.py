"""Registered queries: whole-table plans and the SQL that they are held against."""
