"""Loan-portfolio analytics written for Spark DataFrames."""
