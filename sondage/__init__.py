"""sondage: data profiling, model scoring and corpus operators as Spark DataFrame plans."""
