"""touchline: squad analytics and corpus preparation, written as Spark jobs."""
