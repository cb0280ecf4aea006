"""PySpark-native analytics for transaction-alert triage."""
