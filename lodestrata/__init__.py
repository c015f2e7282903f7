"""lodestrata: PySpark-native analytics for large, messy inventories of companies and people."""
