"""Registered queries of the fact library with the SQL that they are held against."""
