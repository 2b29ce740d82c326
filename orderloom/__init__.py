"""orderloom: a PySpark-native engine for order-flow, bar and corpus analytics."""
