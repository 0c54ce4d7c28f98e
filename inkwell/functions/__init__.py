"""Column builders: scalar functions over text, URLs and identities, all inside the JVM."""
