"""Detection, arbitration, scoring, masking and restoring of sensitive text, on Spark."""
