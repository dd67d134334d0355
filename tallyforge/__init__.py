"""tallyforge: analytics and data preparation for receipt data on PySpark."""
