"""Reading repertoire directories and writing feature tables, predictions and models."""
