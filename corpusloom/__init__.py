"""Mixed-language corpus analytics as Spark DataFrame plans."""
