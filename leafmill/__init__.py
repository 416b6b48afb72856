"""leafmill: a Spark-native engine for long documents and bilingual text corpora."""
