"""quern: message, conversation and corpus analytics written as Spark DataFrame jobs."""
