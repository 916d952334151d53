"""markloom: assessment analytics as PySpark DataFrame operators."""
