"""Receipt analytics on Spark: DataFrame jobs over tables of AI-execution receipts."""
