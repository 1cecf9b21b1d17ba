"""Spark-native pipeline for CRM entity data: land, upsert, flatten, deliver, operate."""
