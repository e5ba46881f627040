"""A document-analytics engine made of Spark DataFrame stages."""
