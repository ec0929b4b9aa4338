"""textloom: web-page text extraction and scrape-job analytics on Spark DataFrames."""
