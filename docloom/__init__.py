"""docloom: a Spark-native engine for documentation corpora, from raw pages to evaluated retrieval."""
