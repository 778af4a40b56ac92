"""galley: web pages in, publishable articles out, as Spark DataFrame jobs."""
