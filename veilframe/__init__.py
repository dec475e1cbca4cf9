"""Detection, pseudonymization and restoration of sensitive text over Spark datasets."""
