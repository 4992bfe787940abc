"""logweave: timestamped message logs turned into training-ready tables, as Spark DataFrame operators."""
