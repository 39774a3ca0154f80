"""Shoplens: review and commerce analytics expressed as Spark DataFrame plans."""
