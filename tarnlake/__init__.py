"""Event and sales analytics as Spark DataFrame jobs over keyed Parquet tables."""
