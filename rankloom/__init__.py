"""Link analysis, graph retrieval and crawl ranking on Spark DataFrames."""
