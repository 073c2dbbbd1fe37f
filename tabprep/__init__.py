"""Clean, profile, type, validate and assign large collections of tabular sheets with Spark."""
