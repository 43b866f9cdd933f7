"""Spark jobs for bank-statement analytics over many accounts and files."""
