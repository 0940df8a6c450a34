"""MLlib estimators and training loops over repertoire vectors."""
