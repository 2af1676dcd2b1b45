"""quarry: discovery analytics over parameterised instances, written against the Spark DataFrame API."""
