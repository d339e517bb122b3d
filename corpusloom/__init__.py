"""corpusloom: a Spark-native engine for bilingual and monolingual text corpora."""
