"""Urban temperature data jobs for Spark: cleaning, gridding, heat events, verification and audits."""
