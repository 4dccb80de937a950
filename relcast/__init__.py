"""Release analytics over structured content, as lazy Spark DataFrame plans."""
