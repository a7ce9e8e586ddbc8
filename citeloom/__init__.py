"""Citation-impact analytics as table-to-table Spark operators."""
