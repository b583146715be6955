"""Queries of the library over the project's tables, each with SQL that gives the same rows where SQL can."""
