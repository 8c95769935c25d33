"""Point-in-time retail analytics as DataFrame operators on Apache Spark."""
