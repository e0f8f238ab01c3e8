"""graphloom: knowledge-graph analytics and large-scale record processing, declared as Spark plans."""
