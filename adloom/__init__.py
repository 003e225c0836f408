"""Ad-log analytics as PySpark DataFrame transformations."""
