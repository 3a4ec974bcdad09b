"""Surge and event-study analytics on panel data, expressed as Spark DataFrame operators."""
