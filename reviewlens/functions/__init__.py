"""Native column expressions, without Python UDFs."""
