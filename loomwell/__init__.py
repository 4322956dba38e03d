"""loomwell: expression, annotation, ontology and literature analytics as Spark jobs."""
