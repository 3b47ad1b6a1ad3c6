"""Meridia: fee-schedule reference data, geography, pricing and data quality as Spark jobs."""
