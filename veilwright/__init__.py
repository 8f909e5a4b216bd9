"""Finding, masking and reporting personal data and secrets in text tables, on Spark."""
