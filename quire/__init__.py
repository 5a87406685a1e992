"""quire: analytics over corpora of PDF documents, as Spark relations."""
