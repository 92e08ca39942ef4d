"""tidemill: a DataFrame-first analytics engine on Apache Spark."""
