"""Knowledge-graph and ontology building as Spark DataFrame jobs."""
