"""Air-quality features on Spark: landed payloads to raw, validated and fused daily tables."""
