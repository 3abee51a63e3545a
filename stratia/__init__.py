"""stratia: corpus analytics expressed as Spark DataFrame jobs."""
