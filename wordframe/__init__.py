"""Spark-native analytics over keyed token sequences."""
