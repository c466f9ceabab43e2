"""tessera: a code-graph analytics engine on the PySpark DataFrame API."""
