"""Millrace: Spark-first analytics operators (DataFrame / SQL), with thin helpers only where Catalyst has no operator."""
