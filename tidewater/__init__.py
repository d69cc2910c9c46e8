"""Tidewater: a PySpark-native analytics engine made of composable DataFrame operators."""
