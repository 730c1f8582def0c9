"""Spark-native analytics for check-ins, social ties, knowledge graphs and ranking evaluation."""
