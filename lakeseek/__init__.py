"""lakeseek: document extraction, maintenance and hybrid retrieval as Spark jobs."""
