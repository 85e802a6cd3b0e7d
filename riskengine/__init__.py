"""Point-in-time payment-risk analytics expressed as Spark jobs."""
