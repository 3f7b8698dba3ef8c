"""Ticket analytics and delay-policy evaluation on Spark DataFrames."""
