"""Registered queries: operators over the domain tables, each with the SQL that must give the same rows."""
